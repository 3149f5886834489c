"""Every registered query against the SQL that defines it, on the smallest tables."""

import math

import pytest

from feedloom.registry import ORACLE_SQL, QUERIES
from tests.conftest import SF


def norm(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return str(v) if hasattr(v, "isoformat") else float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


def compare(spark, duck, name, queries, sqls, sf=SF):
    df = queries[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.sql(sqls[name])
    assert sorted(want.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    expected = norm(duck.sql(f"SELECT {quoted} FROM ({sqls[name]}) x").fetchall())
    got = norm(df.select(*[f"`{c}`" for c in cols]).collect())
    assert len(got) == len(expected)
    wrong = [(a, b) for a, b in zip(got, expected) if a != b]
    assert not wrong, wrong[:3]


#: Queries that train a model, which no SQL can say; their operators have tests of their own.
TRAINED = {"multitask_auc", "prerank_boosted", "ranking_embedded_auc", "towers_by_day", "two_tower_metrics"}


def test_only_training_has_no_definition():
    assert set(QUERIES) - set(ORACLE_SQL) == TRAINED


@pytest.mark.parametrize("name", sorted(TRAINED))
def test_trained(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(0 <= r[c] <= 1 for r in rows for c in ("auc", "recall", "hitrate", "ndcg") if c in r)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_definition(spark, duck, name):
    compare(spark, duck, name, QUERIES, ORACLE_SQL)
