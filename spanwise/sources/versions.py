"""Results kept as published versions: data in a folder of their own first, then one pointer that names it.

A reader follows the pointer, so it sees the old version or the new one, whatever a writer dies of in between; the
pointer is replaced by one rename. The version that is replaced stays until the next one, for readers that have begun
with it; older ones go.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current"


def _jvm(spark: SparkSession, path: str):
    """Hadoop's path, its file system and its file context."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at = hadoop.Path(path)
    system = at.getFileSystem(conf)
    return at, system, hadoop.FileContext.getFileContext(system.getUri(), conf)


def _pointer(spark: SparkSession, path: str) -> dict | None:
    at, system, _ = _jvm(spark, f"{path}/{POINTER}")
    if not system.exists(at):
        return None
    try:
        held = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{POINTER}").collect()))
    except ValueError:
        return None
    return held if isinstance(held, dict) and {"note", "data"} <= set(held) else None


def _point(spark: SparkSession, path: str, value: dict) -> None:
    """The pointer's text is written beside it and takes its place by a rename."""
    fresh, system, context = _jvm(spark, f"{path}/{POINTER}-{uuid.uuid4().hex}")
    out = system.create(fresh, True)
    out.write(bytearray(json.dumps(value, sort_keys=True), "utf-8"))
    out.close()
    gateway = spark.sparkContext._gateway
    rename = getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(fresh, _jvm(spark, f"{path}/{POINTER}")[0], how)


def publish(df: DataFrame, path: str, note: dict) -> None:
    """Makes df the current version at the path, made under the note (settings, and what the inputs were)."""
    spark = df.sparkSession
    before = (_pointer(spark, path) or {}).get("data")
    name = f"version-{hashlib.sha256(json.dumps(note, sort_keys=True).encode()).hexdigest()[:12]}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{name}")
    _point(spark, path, {"note": note, "data": name})
    at, system, _ = _jvm(spark, path)
    for status in system.listStatus(at):
        old = status.getPath()
        if old.getName().startswith("version-") and old.getName() not in (name, before):
            system.delete(old, True)


def current(spark: SparkSession, path: str, note: dict | None = None) -> DataFrame | None:
    """The current version, or None if there is none, or none that was made under this note; a broken pointer, or one whose
    data are gone or unfinished, is a miss."""
    held = _pointer(spark, path)
    if held is None or note is not None and held["note"] != json.loads(json.dumps(note)):
        return None
    done, system, _ = _jvm(spark, f"{path}/{held['data']}/_SUCCESS")
    return spark.read.parquet(f"{path}/{held['data']}") if system.exists(done) else None


def table_note(df: DataFrame) -> dict:
    """What identifies a table's rows in a note, in any order: their number, and the sum of their hashes. One pass."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(20,0)")).alias("sum")).first()
    return {"columns": df.columns, "rows": row["rows"], "sum": str(row["sum"])}
