"""A sink for results that never loses coverage by accident: staged, compared, switched in one step.

A result is a folder with ``versions/<id>/`` (JSON rows) and ``current.json``, which names the version that counts and what
it was made with. A new version is written beside the others; only when it is whole, and covers all that the one before
covered, is ``current.json`` replaced, by a rename. A run that fails, or is refused, leaves the result as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from feedloom.operators.stage import remove


class Refused(ValueError):
    """The new result covers less than the one there, or means something else."""


def _paths(spark: SparkSession):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, spark._jsc.hadoopConfiguration()


def _read(spark: SparkSession, path: str) -> dict | None:
    hadoop, conf = _paths(spark)
    at = hadoop.Path(f"{path}/current.json")
    if not at.getFileSystem(conf).exists(at):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/current.json", wholetext=True).collect()))


def _switch(spark: SparkSession, path: str, said: dict) -> None:
    hadoop, conf = _paths(spark)
    new, final = hadoop.Path(f"{path}/.current-{uuid.uuid4().hex}"), hadoop.Path(f"{path}/current.json")
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(json.dumps(said, sort_keys=True).encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(new.toUri(), conf).rename(new, final, overwrite)


def write_result(rows: DataFrame, path: str, cover: list[str], made_with: dict | None = None, force: bool = False) -> dict:
    """Make ``rows`` the result at ``path``; what ``current.json`` then says.

    ``cover``: the columns whose distinct values say what a result covers. With values that the result there has and
    ``rows`` lacks, or another value of something in ``made_with`` that both name, it is refused and nothing changes,
    unless ``force``. ``rows`` are computed once; both coverages are read from the written files.
    """
    spark, version = rows.sparkSession, uuid.uuid4().hex
    before = _read(spark, path)
    at = f"{path}/versions/{version}"
    try:
        rows.write.json(at)
        written = spark.read.schema(rows.schema).json(at)
        if before and not force:
            other = {k: (v, (made_with or {})[k]) for k, v in before["made_with"].items() if k in (made_with or {}) and (made_with or {})[k] != v}
            if other:
                raise Refused(f"the result there was made with another meaning: {other}")
            old = spark.read.schema(rows.schema).json(f"{path}/versions/{before['version']}")
            lost = old.select(*cover).distinct().exceptAll(written.select(*cover).distinct()).limit(6).collect()
            if lost:
                raise Refused(f"the new result would lose {[r.asDict() for r in lost[:5]]}" + " and more" * (len(lost) > 5))
    except BaseException:
        remove(spark, at)
        raise
    said = {"version": version, "cover": cover, "made_with": made_with or {}}
    _switch(spark, path, said)
    if before:
        remove(spark, f"{path}/versions/{before['version']}")
    return said


def read_result(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that count at ``path``; no result is an error."""
    said = _read(spark, path)
    if said is None:
        raise FileNotFoundError(path)
    return spark.read.schema(schema).json(f"{path}/versions/{said['version']}")
