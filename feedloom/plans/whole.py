"""Query: whole training samples, every feature family and the static sides on each row once, guarded."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import encoding, samples, strict, windows
from feedloom.plans.common import EV, query
from feedloom.plans.features import _rolling_sql
from feedloom.views import LABELS, log_events, table, with_split

_KEPT = "split IN ('train', 'valid', 'test')"
_PAIR = ("is_click", "long_view", "is_like")
#: Prefix, keys, partner, labels, labels with rates, windows of each family.
FAMILIES = (("u", ("user_id",), "video_id", LABELS, LABELS, (1, 3, 7)), ("i", ("video_id",), "user_id", LABELS, LABELS, (1, 3, 7)), ("p", ("user_id", "author_id"), "video_id", _PAIR, _PAIR[:2], (3, 7)))


def columns_of(prefix: str, labels: tuple, rates: tuple, ws: tuple) -> list[str]:
    """A family's columns, plain rates left out where it is the pair's."""
    out = [f"{prefix}_{c}_{w}d" for w in ws for c in ("imp", *labels)] + [f"{prefix}_active_days_{max(ws)}d", f"{prefix}_distinct_{max(ws)}d"]
    out += [f"{prefix}_{c}_{kind}_{w}d" for w in ws for c in rates for kind in (("smooth",) if prefix == "p" else ("rate", "smooth"))]
    return out + ([f"{prefix}_trend"] if 1 in ws else []) + [f"{prefix}_has_history"]


def _cold_sql(c: str, prefix: str) -> str:
    kind = encoding.classify(c)
    if kind == "smooth":
        label = c.removeprefix(f"{prefix}_").partition("_smooth_")[0]
        return f"round(coalesce({prefix}.{c}, g.{label}), 9) AS {c}"
    return f"{prefix}.{c} AS {c}" if kind in ("naive", "trend") else f"coalesce({prefix}.{c}, 0) AS {c}"


def _join_sql(prefix: str, keys: tuple) -> str:
    return " AND ".join(f"{prefix}.{k} = s.{k}" for k in (*keys, "date"))


@query(f"""WITH {EV}, g AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in LABELS)} FROM lg WHERE split = 'warmup'), {', '.join(f'{p} AS ({_rolling_sql(", ".join(keys), other, p, labels, rates, ws)})' for p, keys, other, labels, rates, ws in FAMILIES)}
SELECT s.event_id, s.split, {', '.join(_cold_sql(c, p) for p, _, _, labels, rates, ws in FAMILIES for c in columns_of(p, labels, rates, ws))}, c_acctbal AS balance, coalesce(c_mktsegment, '') AS segment, coalesce(p_brand, '') AS brand, p_size AS size
FROM lg s CROSS JOIN g {' '.join(f'LEFT JOIN {p} ON {_join_sql(p, keys)}' for p, keys, *_ in FAMILIES)} LEFT JOIN customer ON c_custkey = s.user_id LEFT JOIN part ON p_partkey = s.video_id WHERE s.{_KEPT}""")
def sample_whole(spark, sf):
    """Every sample once with the user's, item's and pair's features of the days before, cold values and static sides.

    The features come back to the samples through a join that stops if a row is lost, or is there twice.
    """
    log = with_split(log_events(spark, sf))
    kept = log.where(_KEPT)
    prior = windows.priors(log, list(LABELS))
    parts = []
    for prefix, keys, other, labels, rates, ws in FAMILIES:
        rolled = windows.rolling(log, list(keys), other, list(labels), list(rates), list(ws), windows.priors(log, list(labels)), prefix, need=kept.select(*keys, "date"))
        cold = {}
        for c in columns_of(prefix, labels, rates, ws):
            kind = encoding.classify(c)
            label = c.removeprefix(f"{prefix}_").partition("_smooth_")[0]
            cold[c] = F.col(f"g_{label}") if kind == "smooth" else F.lit(None).cast("double") if kind in ("naive", "trend") else F.lit(0)
        parts.append((rolled, [*keys, "date"], cold))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("video_id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    parts += [(users, ["user_id"], {"balance": F.lit(None).cast("double"), "segment": F.lit("")}), (items, ["video_id"], {"brand": F.lit(""), "size": F.lit(None).cast(items.schema["size"].dataType)})]
    made = samples.assemble(kept.crossJoin(F.broadcast(prior)), parts)
    names = [c for p, _, _, labels, rates, ws in FAMILIES for c in columns_of(p, labels, rates, ws)]
    shown = made.select("event_id", *[F.round(c, 9).alias(c) if encoding.classify(c) in ("smooth", "naive", "trend") else F.col(c) for c in names], "balance", "segment", "brand", "size")
    return strict.same_rows(kept.select("event_id", "split"), shown, "event_id")
