"""Every query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from offerloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df):
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_a_name_is_one_query():
    """journal_tail reads marks, rules and hidden rows; another query of its name took its place."""
    from offerloom.plans import journal_plans
    from offerloom.plans.base import query

    def journal_tail(spark, sf_dir):
        pass

    with pytest.raises(ValueError):
        query("SELECT 1")(journal_tail)
    assert QUERIES["journal_tail"] is journal_plans.journal_tail and journal_plans.LATEST in ORACLES["journal_tail"]
