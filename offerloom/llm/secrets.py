"""Secret scans by one deterministic automaton for all rules.

The rules' regular expressions (literals, classes, groups, ``|``, ``?``, ``*``, ``+`` and
``{m,n}`` over ASCII) are compiled together: expressions to a nondeterministic automaton
(Thompson), that to a deterministic one by subset construction, and that to the smallest
by partition refinement.  The automaton reads each text's bytes once, from the last to
the first, over the reversed expressions; its state at a byte says which rules have a
match that starts there.  From the leftmost start at or after the previous match's end,
a small forward automaton of that one rule finds the longest match.  Leftmost longest
matches that don't overlap result, for every rule on its own.

For the three base rules this equals a leftmost greedy regex search, as in each of them
the text leaves no choice of how to match.  Matches under the rule's least length are
dropped after they have been consumed.  (The hex rule counts its 16 inside the automaton:
its matches are whole runs, so a short one hides nothing.)

Null texts are empty; empty texts hold no secrets.  Offsets are code points.  Very long texts
are read whole, a short slice of a batch at a time.  Repeated rows each get their spans, so
equal texts get equal ones; an empty table gives an empty result, and columns beside the text
(and ``doc_id`` in the report) are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import getitem, itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import text_slices


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least length of what follows ``head`` (of the whole match if there is none).
    least: int = 1
    #: The part of a match in front of the value; same syntax.
    head: str = ""
    fold: bool = False  # letters of ``head`` in either case


ASSIGN_HEAD = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: The three base rules, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", 12, ASSIGN_HEAD, True),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),
)
#: Formats that the base rules don't know.
MORE_RULES = (
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("cloud", "AIza[A-Za-z0-9_-]+", 39),
    Rule("url_login", "[a-z][a-z0-9+.-]*://[A-Za-z0-9_.-]+:[A-Za-z0-9_.!*-]+@"),
)
RULES = BASE_RULES + MORE_RULES


# Expressions as nested tuples: ("set", bytes) ("cat", ...) ("alt", ...) ("rep", x, low, high or None)
def parse(pattern: str, fold: bool = False) -> tuple:
    at = 0

    def peek() -> str:
        return pattern[at : at + 1]

    def take() -> str:
        nonlocal at
        at += 1
        return pattern[at - 1]

    def one() -> int:
        """A literal byte, escapes resolved."""
        nonlocal at
        c = take()
        if c == "\\":
            c = take()
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
        return ord(c)

    def both(members: set[int]) -> tuple:
        if fold:
            members |= {ord(f(chr(b))) for b in members if chr(b).isascii() and chr(b).isalpha() for f in (str.lower, str.upper)}
        return ("set", frozenset(members))

    def atom() -> tuple:
        if peek() == "(":
            take()
            x = alternatives()
            take()
            return x
        if peek() != "[":
            return both({one()})
        take()
        members: set[int] = set()
        while peek() != "]":
            low = one()
            if peek() == "-" and pattern[at + 1] != "]":
                take()
                members |= set(range(low, one() + 1))
            else:
                members.add(low)
        take()
        return both(members)

    def repeated() -> tuple:
        nonlocal at
        x = atom()
        while peek() and peek() in "?*+{":
            c = take()
            if c == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at:end].partition(",")
                x = ("rep", x, int(low), int(high) if high else None if "," in pattern[at:end] else int(low))
                at = end + 1
            else:
                x = ("rep", x, int(c == "+"), 1 if c == "?" else None)
        return x

    def alternatives() -> tuple:
        found = [[]]
        while peek() and peek() != ")":
            if peek() == "|":
                take()
                found.append([])
            else:
                found[-1].append(repeated())
        made = [("cat", *x) for x in found]
        return made[0] if len(made) == 1 else ("alt", *made)

    return alternatives()


def reverse(x: tuple) -> tuple:
    if x[0] == "cat":
        return ("cat", *map(reverse, x[:0:-1]))
    if x[0] == "alt":
        return ("alt", *map(reverse, x[1:]))
    return ("rep", reverse(x[1]), *x[2:]) if x[0] == "rep" else x


class Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, x: tuple, start: int) -> int:
        """States for ``x`` from ``start``; returns its end."""
        if x[0] == "set":
            end = self.state()
            mid = self.state()
            self.empty[start].append(mid)
            self.step[mid] = (x[1], end)
            return end
        if x[0] == "cat":
            for part in x[1:]:
                start = self.add(part, start)
            return start
        end = self.state()
        if x[0] == "alt":
            for part in x[1:]:
                self.empty[self.add(part, self._after(start))].append(end)
            return end
        _, part, low, high = x
        for _ in range(low):
            start = self.add(part, self._after(start))
        if high is None:
            loop = self._after(start)
            self.empty[self.add(part, self._after(loop))].append(loop)
            self.empty[loop].append(end)
        else:
            self.empty[start].append(end)
            for _ in range(high - low):
                start = self.add(part, self._after(start))
                self.empty[start].append(end)
        return end

    def _after(self, start: int) -> int:
        new = self.state()
        self.empty[start].append(new)
        return new

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def determinise(nfa: Nfa, start: int, ends: dict[int, int], anywhere: bool) -> tuple[list[list[int]], list[int]]:
    """Subset construction.  ``ends`` maps an end state to its rule's bit; ``anywhere`` lets
    a match begin at every byte.  Returns transitions by byte and, by state, the bits accepted."""
    first = nfa.closure([start])
    ids, sets, moves = {first: 0}, [first], []
    while len(moves) < len(sets):
        by_byte: dict[int, set[int]] = {}
        for s in sets[len(moves)]:
            if step := nfa.step[s]:
                for b in step[0]:
                    by_byte.setdefault(b, set()).add(step[1])
        row, known = [], {}
        for b in range(256):
            key = frozenset(by_byte.get(b, ()))
            if key not in known:
                to = nfa.closure(key) | (first if anywhere else frozenset())
                if to not in ids:
                    ids[to] = len(sets)
                    sets.append(to)
                known[key] = ids[to]
            row.append(known[key])
        moves.append(row)
    return moves, [sum({ends[s] for s in x if s in ends}) for x in sets]


def minimise(moves: list[list[int]], accepts: list[int]) -> tuple[list[list[int]], list[int]]:
    """Partition refinement until no block's states differ in what they accept or where they lead."""
    block = accepts
    while True:
        names: dict[tuple, int] = {}
        new = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(moves)]
        if len(names) == len(set(block)):
            break
        block = new
    out, bits = [[]] * len(names), [0] * len(names)
    for s, b in enumerate(new):
        out[b], bits[b] = [new[t] for t in moves[s]], accepts[s]
    order = [new[0], *(b for b in range(len(names)) if b != new[0])]  # the start comes first
    at = {b: i for i, b in enumerate(order)}
    return [[at[t] for t in out[b]] for b in order], [bits[b] for b in order]


#: In a linked row, what is accepted stands behind the 256 followers.
ACCEPTS = 256


def linked(moves: list[list[int]], accepts: list[int]) -> list:
    """The transition arrays as rows that hold their followers, so that indexing by a byte leads to the next row."""
    rows: list[list] = [[] for _ in moves]
    for row, to, bits in zip(rows, moves, accepts):
        row.extend([*(rows[t] for t in to), bits])
    return rows[0]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nfa, ends = Nfa(), {}
        start = nfa.state()
        for i, rule in enumerate(rules):
            whole = ("cat", parse(rule.head, rule.fold), parse(rule.pattern))
            ends[nfa.add(reverse(whole), nfa._after(start))] = 1 << i
        self.moves, self.accepts = minimise(*determinise(nfa, start, ends, anywhere=True))
        self.backward = linked(self.moves, self.accepts)
        self.forward = [linked(*minimise(*self._one(parse(r.head, r.fold), parse(r.pattern)))) for r in rules]
        self.heads = [linked(*minimise(*self._one(parse(r.head, r.fold)))) if r.head else None for r in rules]

    @staticmethod
    def _one(*parts: tuple) -> tuple[list[list[int]], list[int]]:
        nfa = Nfa()
        start = nfa.state()
        end = nfa.add(("cat", *parts), start)
        return determinise(nfa, start, {end: 1}, anywhere=False)

    @staticmethod
    def _longest(row: list, data: bytes, start: int) -> int:
        """Where the longest match from ``start`` ends; -1 if there is none."""
        end, dead = -1, None
        for i in range(start, len(data)):
            row = row[data[i]]
            if row[ACCEPTS]:
                end = i + 1
            elif row is row[0] and all(t is row for t in row[:ACCEPTS]):
                dead = row
            if row is dead:
                break
        return end

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start byte, rule, end byte), sorted."""
        states = accumulate(reversed(data), getitem, initial=self.backward)
        hits = [(len(data) - n, bits) for n, bits in filter(itemgetter(1), enumerate(map(itemgetter(ACCEPTS), states)))]
        found = []
        for i, rule in enumerate(self.rules):
            free = 0
            for start, bits in reversed(hits):
                if not bits >> i & 1 or start < free:
                    continue
                free = self._longest(self.forward[i], data, start)
                value = self._longest(self.heads[i], data, start) if rule.head else start
                if free - value >= rule.least:
                    found.append((start, i, free))
        return sorted(found)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """As ``scan``, in code points."""
        found = self.scan(data := text.encode())
        if found and not text.isascii():
            found = [(len(data[:a].decode()), i, len(data[:b].decode())) for a, i, b in found]
        return found


@functools.cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``array<struct<kind,start,end>>`` of each text, by start, then in the rules' order."""

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(SPAN_TYPE)
    def spans_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = scanner(rules)
        for texts in batches:
            yield pa.array([[{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in s.spans(t)] for some in text_slices(texts) for t in some], kind)

    return spans_of(text)


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base rules' spans, a digest of those, and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    found = docs.select("doc_id", secret_spans(F.coalesce("text", F.lit(""))).alias("s"))
    of = lambda *kinds: F.filter("s", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(said(of(*base)), 256).alias("base_sha256"),
        said(F.col("s")).alias("spans"),
    )


def redact(text: Column, rules: tuple[Rule, ...] = RULES, mark: str = "[{}]") -> Column:
    """Each text with every run of overlapping spans replaced by the first one's kind; null stays null."""

    @F.arrow_udf("string")
    def redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = scanner(rules)

        def one(t: str) -> str:
            out, at = [], 0
            for a, i, b in s.spans(t):
                if a >= at:
                    out += [t[at:a], mark.format(rules[i].kind)]
                at = max(at, b)
            return "".join(out) + t[at:] if out else t

        for texts in batches:
            done = pa.array([one(t) for some in text_slices(texts) for t in some], pa.string())
            yield pc.if_else(pc.is_valid(texts), done, pa.scalar(None, pa.string()))

    return redacted(text)
