"""A report on a table's columns from one scan: exact counts and bounds, and mergeable sketches of what would need a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: Relative deviation of the distinct counts, and the most values that a column's quantile sketch keeps.
RSD, ACCURACY = 0.02, 10_000
SHARES = (0.25, 0.5, 0.75)
#: Values named as frequent.
TOP = 3

COLUMNS = ("column", "kind", "rows", "nulls", "null_rate", "distinct", "least", "greatest", "mean", "quartiles", "frequent")


def report(rows: DataFrame) -> DataFrame:
    """(column, kind, rows, nulls, null_rate, distinct, least, greatest, mean, quartiles, frequent), a row for each column.

    One aggregation without groups over all columns, so the table is read once and only one row of sketches per task is
    sent. Exact: rows, nulls, null_rate, least and greatest (as text) and mean. Sketches: ``distinct`` within RSD of the
    truth (one deviation), ``quartiles`` of numbers, values whose rank is off by at most rows / ACCURACY, and ``frequent``,
    up to TOP values with estimated counts, the most frequent first. What a type has not is null: nested columns have
    counts of nulls only. An empty table has a row for each column too.
    """
    n = F.count("*")
    parts = []
    for f in rows.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        number = isinstance(kind, NumericType)
        plain = number or isinstance(kind, (StringType, BooleanType, DateType, TimestampType, TimestampNTZType))
        text = F.lit(None).cast("string")
        frequent = F.expr(f"approx_top_k(`{f.name}`, {TOP})") if plain and not isinstance(kind, BooleanType) else None
        listed = F.array_join(F.transform(frequent, lambda x: F.concat(F.coalesce(x["item"].cast("string"), F.lit("null")), F.lit(":"), x["count"].cast("string"))), ", ") if frequent is not None else text
        quartiles = F.array_join(F.percentile_approx(c, [*SHARES], ACCURACY).cast("array<string>"), ", ") if number else text
        parts.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(kind.simpleString()).alias("kind"), n.alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.when(n > 0, F.count_if(c.isNull()) / n).alias("null_rate"),
            (F.approx_count_distinct(c, RSD) if plain else F.lit(None).cast("long")).alias("distinct"), (F.min(c).cast("string") if plain else text).alias("least"), (F.max(c).cast("string") if plain else text).alias("greatest"),
            (F.avg(c.cast("double")) if number else F.lit(None).cast("double")).alias("mean"), quartiles.alias("quartiles"), listed.alias("frequent"),
        ))
    return rows.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def as_markdown(made: DataFrame, title: str) -> str:
    """The report as a table in Markdown, columns by falling share of nulls, then by name."""
    def cell(x: object) -> str:
        return "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")

    found = sorted(made.collect(), key=lambda r: (-(r["null_rate"] or 0), r["column"]))
    lines = [f"# {title}", "", "| " + " | ".join(COLUMNS) + " |", "|" + "-|" * len(COLUMNS)]
    return "\n".join([*lines, *["| " + " | ".join(cell(r[c]) for c in COLUMNS) + " |" for r in found]]) + "\n"
