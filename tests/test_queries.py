"""Every registered query of the library against its SQL counterpart on the smallest tables."""

import pytest

from quern.plans.queries import ORACLE, QUERIES

from .compare import database, rows, sql

UNSQL = sorted(set(QUERIES) - set(ORACLE))


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), sql(con, ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", UNSQL)
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_gives_answers(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.count() > 0 and {"qid", "answer_mode", "answer"} <= set(out.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
