"""Every query against its SQL on the smallest tables; those without SQL must give rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from corpusloom import queries as q
from tests.conftest import DATA


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, views, name):
    got, want = q.QUERIES[name](spark, DATA).toPandas(), views.execute(q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(q.QUERIES.keys() - q.ORACLES.keys()))
def test_gives_rows(spark, name):
    assert not q.QUERIES[name](spark, DATA).isEmpty()


def test_rules_change_something(spark):
    """A cleaning query whose output equals its input would prove nothing."""
    whole = q.lines(spark, DATA).count()
    assert q.line_dedup(spark, DATA).count() < whole
    assert q.join_broken_lines(spark, DATA).count() < whole
    assert q.layout_noise_filter(spark, DATA).count() < q.page_lines(spark, DATA).count()
    assert q.typo_fix(spark, DATA).where("typos > 0").count() > 0
    assert q.recent_window(spark, DATA).where("cut_by_chars > 0").count() > 0
    assert q.memory_fold(spark, DATA).where("in_summary").count() > 0
