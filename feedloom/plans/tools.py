"""Queries over the sources and guards: column report, head of an ordered dataset, checked metrics, a stored result."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import report, retrieval, strict
from feedloom.operators.stage import Stage
from feedloom.plans.common import EV, query
from feedloom.sources import head, results
from feedloom.views import log_events, table, with_split

_PART = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "number", "p_retailprice": "number"}


def _column_sql(c: str, kind: str) -> str:
    mean = f"round(avg(CAST({c} AS DOUBLE)), 6)" if kind != "string" else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} IS NULL) / count(*) AS null_rate, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest, {mean} AS mean,
count(DISTINCT {c}) BETWEEN 0.9 * count(DISTINCT {c}) AND 1.1 * count(DISTINCT {c}) AS distinct_near FROM part"""


@query(" UNION ALL ".join(_column_sql(c, k) for c, k in _PART.items()))
def column_report(spark, sf):
    """Exact figures of every column from one scan; ``distinct_near`` holds the sketch against an exact count, within a tenth."""
    part = table(spark, sf, "part").select(*_PART)
    exact = part.agg(*[F.count_distinct(c).alias(c) for c in _PART]).unpivot([], list(_PART), "column", "truth")
    made = report.report(part).join(exact, "column")
    return made.select("column", "rows", "nulls", "null_rate", "least", "greatest", F.round("mean", 6).alias("mean"), (F.abs(F.col("distinct") - F.col("truth")) <= 0.1 * F.col("truth")).alias("distinct_near"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 700")
def ordered_head(spark, sf):
    """The first 700 events of a dataset in files by ranges: only files that can hold them are read."""
    stage = Stage(spark)
    stage.write(table(spark, sf, "events").select("event_id", "user_id", "event_type").repartitionByRange(12, "event_id"), "events")
    return head.first_n(spark, stage.paths["events"], ["event_id"], 700)


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s), t AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id FROM e q, e i WHERE q.vec_id % 100 = 0 AND (i.vec_id % 41 = (q.vec_id // 100) % 41 OR i.vec_id = q.vec_id)),
n AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1), h AS (SELECT t.query_id, k, n, count(*) FILTER (rank <= k) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg FROM t JOIN n USING (query_id) LEFT JOIN r ON r.query_id = t.query_id AND r.item_id = t.item_id AND rank <= 20, (VALUES (5), (20)) x(k) GROUP BY ALL)
SELECT CAST(k AS INT) AS k, count(*) AS requests, round(avg(hits / n), 9) AS recall, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 9) AS hitrate, round(avg(dcg / (SELECT sum(1 / log2(j + 1)) FROM range(1, least(n, k) + 1) y(j))), 9) AS ndcg FROM h GROUP BY k""")
def checked_metrics(spark, sf):
    """Recall, hit rate and NDCG of exact top-20 answers, with answers and targets checked while they are grouped."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    top = retrieval.exact_top_k(asked, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 20)
    group = (F.floor(F.col("query_id") / 100) % 41).alias("g")
    same = asked.select("query_id", group).join(e.select(F.col("vec_id").alias("item_id"), (F.col("vec_id") % 41).alias("g")), "g").select("query_id", "item_id")
    targets = same.unionByName(asked.select("query_id", F.col("query_id").alias("item_id"))).distinct()
    per = strict.retrieval_metrics(top.select("query_id", "item_id", "rank"), targets, ["query_id"], [20, 5], 20)
    return per.groupBy("k").agg(F.count("*").alias("requests"), *[F.round(F.avg(c), 9).alias(c) for c in ("recall", "hitrate", "ndcg")])


@query(f"WITH {EV} SELECT split, tab, count(*) AS n, CAST(sum(is_click) AS BIGINT) AS clicks FROM lg GROUP BY 1, 2")
def stored_result(spark, sf):
    """Clicks by split and scene, written to the sink twice, the second time as the same coverage, and read back."""
    rows = with_split(log_events(spark, sf)).groupBy("split", "tab").agg(F.count("*").alias("n"), F.sum("is_click").alias("clicks"))
    path = f"{Stage(spark).root}/result"
    for _ in range(2):
        results.write_result(rows, path, ["split", "tab"], {"baseline": "none"})
    return results.read_result(spark, path, rows.schema)
