import random
import re

from offerloom.llm.url_filter import RULES, filter_urls

from .helpers import by_id

KIND = "page_id long, url string, html string, host string, plain string, class string"


def brute(url):
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, None)))


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], KIND)


def test_rules_equal_brute_force(spark):
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "m.x.example.com", "xexample.com", "com", "net", "b.net", "org.net.", "", "ÉX.com"]
    paths = ["", "/", "/en", "/en/", "/en/1.html", "/EN/1", "/es/2?u=://x/fr/", "/fr/3#a", "?q=/en/", "#://net/es/"]
    rows = [(i, f"{s}{h}{p}", None) for i, (s, h, p) in enumerate((s, h, p) for s in ("http://", "://", "x://y://", "") for h in hosts for p in paths)]
    rows += [(9001, None, None), (9002, "", ""), (9003, "http://b.net/es/" + "a" * 100_000, None), (9003, "http://b.net/es/" + "a" * 100_000, None)]
    found = filter_urls(table(spark, rows)).collect()
    assert len(found) == len(rows)
    found = {r.page_id: r for r in found}
    for i, u, _ in rows:
        host, path, rule, verdict = brute(u)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule), u
        assert found[i].verdict == verdict or verdict is None
    assert filter_urls(table(spark, [])).count() == 0


def test_decisions_spread_over_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    refresh = '<meta http-equiv="refresh" content="0; url={}">'.format
    rows = [
        (1, "http://a.net/es/x", ""), (2, "http://one.org/p", link("http://a.net/es/x")), (3, "http://two.org/q", refresh("https://one.org/p?x=1")), (4, "http://three.org/r", ""),
        (5, "http://good.com/z", ""), (6, "http://b.net/fr/y", link("http://good.com/z")), (7, "http://four.org/s", link("http://b.net/fr/y")),
        (8, "http://www.two.org/q/#top", ""), (9, "http://far.org/", link("http://out.net/es/")),
    ]
    found = {i: r.verdict for i, r in by_id(filter_urls(table(spark, rows)), "page_id").items()}
    # 3 reaches the blocked 1 over 2; 7's class has an allowed page; 9's target isn't a page, so nothing was decided on it
    assert found == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "block", 9: "allow"}
    more = spark.createDataFrame([("http://three.org/r", "http://two.org/q")], "src string, dst string")
    assert by_id(filter_urls(table(spark, rows), edges=more), "page_id")[4].verdict == "block"


def test_no_python(spark):
    plan = filter_urls(table(spark, [(1, "http://a.net/es/x", "")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_edges_in_every_form(spark):
    shut = "http://a.net/es/x"
    rows = [(1, shut, "")]
    forms = [
        f'<LINK REL="CANONICAL" HREF="{shut}">', f'<META HTTP-EQUIV="REFRESH" CONTENT="0; URL={shut}">', f"<meta http-equiv=refresh content=\"0; url='{shut}'\">", '<link rel="canonical" href="//a.net/es/x">',
        f'<link rel="canonical" href="http://far.org/"><link rel="canonical" href="{shut}">', f'<link rel="nofollow canonical" href=" {shut} ">', f'<meta http-equiv="refresh" content="0; url=/none"><meta http-equiv="refresh" content="3; url={shut}">',
    ]
    rows += [(10 + i, f"http://o{i}.org/p", h) for i, h in enumerate(forms)]
    # relative targets lead to a page of their host that is blocked over its own link
    link = '<link rel="canonical" href="{}">'.format
    rows += [(2, "https://in.org/en/gone", link(shut))]
    inner = ["/en/gone", "gone", "./gone", "../en/gone", "../../en/./x/../gone"]
    rows += [(30 + i, f"https://in.org/en/r{i}", link(t)) for i, t in enumerate(inner)]
    rows += [(40, "https://in.org/en/m", '<meta http-equiv="refresh" content="0;url=gone">'), (41, "https://in.org", link("en/gone"))]
    rows += [(50, "https://in.org/ok", link("mailto:gone")), (51, "https://in.org/ok2", '<link rel="stylesheet" href="/en/gone">'), (52, None, link("/en/gone")), (53, "https://in.org/ok3", None)]
    found = {i: r.verdict for i, r in by_id(filter_urls(table(spark, rows)), "page_id").items()}
    assert {i for i, v in found.items() if v == "allow"} == {50, 51, 52, 53}


def test_queries_of_a_path_are_pages_of_their_own(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [(1, "http://a.net/es/x", ""), (2, "http://host.org/go?u=1", link("http://a.net/es/x")), (3, "http://host.org/go?u=2", ""), (4, "http://host.org/go", ""), (5, "http://host.org/go?u=3", link("http://good.com/z")), (6, "http://good.com/z", "")]
    rows += [(7, "http://one.org/p", link("http://host.org/go?u=1&utm_source=x")), (8, "http://two.org/p", link("http://host.org/go?u=3")), (9, "http://three.org/p", link("http://host.org/go?u=4"))]
    found = {i: r.verdict for i, r in by_id(filter_urls(table(spark, rows)), "page_id").items()}
    assert {i for i, v in found.items() if v == "block"} == {1, 2, 7}


def test_more_rules_than_a_map_holds(spark, monkeypatch):
    from offerloom.llm import url_filter

    rules = [*RULES, ("block", "x.com", "/a"), ("allow", "x.com", "/ab"), ("allow", "tie.org", "/p"), ("block", "tie.org", "/p")]
    rows = table(spark, [(i, u, None) for i, u in enumerate(["http://x.com/a", "http://y.x.com/abc", "http://tie.org/pq", "http://m.net/es/", "http://q.org/", None, "http://www.example.com/en/1"])])
    few = sorted(map(str, filter_urls(rows, rules).collect()))
    monkeypatch.setattr(url_filter, "MOST_RULES", 3)
    assert sorted(map(str, filter_urls(rows, rules).collect())) == few


def test_quoted_targets_comments_and_references(spark):
    shut = "http://a.net/es/my page"
    rows = [(1, shut, "")]
    forms = [
        f'<link rel="canonical" href="{shut}">', f"<link href='{shut}' rel='canonical'>", f'<link title="a > b" rel=canonical href="  {shut}\n">', '<link rel="canonical" href="http://a.net/es/my&#32;page">',
        '<link rel="canonical" href="http://a.net/es/my&#x20;page">', '<link rel="canonical" href="&#104;ttp://a.net/es/my page?utm_source=x&amp;utm_medium=y">', f"<meta content=\"0; url='{shut}'\" http-equiv='Refresh'>",
        f'<!-- x --><link rel="canonical" href="{shut}"><!-- y -->',
    ]
    none = [f'<!-- <link rel="canonical" href="{shut}"> -->', f'<!-- <link rel="canonical" href="{shut}">', f'<link rel="alternate" href="{shut}">', f'<a rel="canonical" href="{shut}">', f'<link rel="canonical" title="{shut}">', '<link rel="canonical" href="http://a.net/es/my">']
    rows += [(10 + i, f"http://o{i}.org/p", h) for i, h in enumerate(forms)] + [(50 + i, f"http://q{i}.org/p", h) for i, h in enumerate(none)]
    found = {i: r.verdict for i, r in by_id(filter_urls(table(spark, rows)), "page_id").items()}
    # (a path may begin like a shorter one: /es/my is another page)
    assert {i for i, v in found.items() if v == "block"} == {1, *range(10, 10 + len(forms))}


def test_random_link_graphs_equal_brute_force(spark):
    """Pages in any spelling, links in any html form, decoys in comments; classes by union-find."""
    for seed in range(3):
        r = random.Random(seed)
        hosts = [f"h{i}.org" for i in range(25)] + ["b.net", "c.net", "good.com"]
        plain = [f"{h}/{p}" for h in hosts for p in ("es/a", "en/b", "fr/c d")]
        spell = lambda p: r.choice(["http://", "https://"]) + r.choice(["", "www.", "m."]) + p + r.choice(["", "/", ".html", "#x", "/#y"])
        pages, edges = [], []
        for i in range(150):
            p, t, html = r.choice(plain), r.choice(plain), "<p>"
            if r.random() < 0.5:
                u = spell(t)
                html = r.choice([f'<link rel="canonical" href="{u}">', f"<link href='{u}' rel=canonical>", f'<meta http-equiv="refresh" content="0; url={u}">', f'<LINK REL="x canonical" HREF=" {u.replace(" ", "&#32;")} ">'])
                edges.append((p, t))
            pages.append((i, spell(p), html + f'<!-- <link rel="canonical" href="{spell(r.choice(plain))}"> -->'))
        root = {p: p for p in plain}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        own = {i: brute(u)[3] for i, u, _ in pages}
        place = {i: next(p for p in plain if re.fullmatch(r"https?://(www\.|m\.)?" + re.escape(p) + r"(/|\.html)?(#.*)?", u)) for i, u, _ in pages}
        said: dict[str, set] = {}
        for i, v in own.items():
            said.setdefault(find(place[i]), set()).add(v)
        want = {i: v or ("block" if "block" in said[find(place[i])] and "allow" not in said[find(place[i])] else "allow") for i, v in own.items()}
        assert {i: x.verdict for i, x in by_id(filter_urls(table(spark, pages)), "page_id").items()} == want
