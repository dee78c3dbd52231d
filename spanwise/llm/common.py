"""What the text operators share: reading, row keys, lower-casing, bounded batches, teaching samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast built-in, others a translation."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


#: Bytes of an Arrow batch that goes to a Python worker. Rows vary from a few bytes to whole books, so the default bound
#: by rows alone can mean gigabytes.
BATCH_BYTES = 2 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows; from here on their session bounds Arrow batches by bytes, unless it has a tighter bound already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(key, str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """The name, behind as many underscores as it takes to be unlike every column of df, in either case."""
    taken, name = {c.lower() for c in df.columns}, f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def row_keys(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a row's identity (id and text together), null-safe."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(0x5EED), *reversed(cols)).alias("k2")]


#: Keys of at most this many rows are broadcast (two longs each, under 50 MB); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of docs whose ``on`` columns aren't among the (checkpointed) keys; null matches null."""
    keys = cut_lineage(keys.distinct())
    renamed = keys.toDF(*[fresh(docs, f"not_{c}") for c in keys.columns])
    renamed = F.broadcast(renamed) if keys.count() <= BROADCAST_KEYS else renamed
    same = [docs[c].eqNullSafe(renamed[fresh(docs, f"not_{c}")]) for c in on]
    return docs.join(renamed, same, "left_anti")


def teaching_rows(docs: DataFrame, labelled: DataFrame, sample: int, shard_rows: int) -> tuple[DataFrame, int]:
    """text, label, shard of about ``sample`` labelled documents (all, where there are fewer), and the number of labels.

    Labels (doc_id, label) are thinned by a hash of the id before they meet the texts, so what is broadcast is bounded by
    the sample and only texts that teach are moved. Repeated rows teach once; of rows with the same id and label the
    least text teaches.
    """
    known = labelled.dropna().distinct()
    n, grain = known.count(), 1 << 30
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < (min(grain, grain * sample // n) if n else 0))
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    shard = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(max(1, min(n, sample) // shard_rows)))
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label", shard.alias("shard")), n
