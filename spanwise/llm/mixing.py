"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to). On these a flow network sends
token capacity from patterns to source quotas: a pattern offers its size once for nothing, a second time at cost 1, and
so on, so the convex cost makes the flow repeat documents only where a quota can't be met otherwise. The flow says how
many words the sources take of each pattern; documents then fill these amounts in seeded order, and only the document
that crosses the end of an amount is cut short.

Patterns and sources stay tables of any length. Quotas come from a few sums over the table of sources. Every amount is
read off a flow: connected components of patterns and sources are dealt to batches, and each batch is a network of its
own, one a task. A component isn't split, so its patterns (not its documents) must fit in a task, at some 1 kB a link.

The seeded order needs no sort over a pattern: documents fall into buckets by the upper bits of a seeded hash, bucket
sizes are summed up within a pattern (a small table), and exact positions are computed within a bucket. A source with a
third of all rows spreads over as many buckets as its share of the rows asks for.

Defined results: a null text has size 0 and takes 0; null is a source of its own, ordered last; a document without
sources takes 0; an empty table gives no rows; repeated rows and equal hashes are ordered by doc_id and size, and rows
that agree in all of these are interchangeable; of several cheapest flows one is taken, the same on every run; a very
long text counts whole and may be the one that is cut short; columns beside doc_id, text and source are ignored, whatever
their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage
from spanwise.llm.flow import Network
from spanwise.llm.simhash import components
from spanwise.operators.prefix import running_sums

WEIGHTS = (5, 2, 1)
SHARE, MOST_REPEATS, SEED = 1.5, 2, 20240601
BUCKET_ROWS = 4096
BATCH_LINKS = 5000
#: Patterns up to this many are broadcast (some 200 bytes each); more are joined by shuffle.
BROADCAST_PATTERNS = 100_000
BLANKS = r"[\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")).cast("long")


def with_targets(sources: DataFrame, whole: int, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """Adds target, the words of each source's quota, to sources (source, source_size).

    The quotas share ``share`` times ``whole``, all documents' size, by weight; none is above ``most`` times its source's
    size, and the excess is shared out again. Sources are ordered by code point, null last, and weigh ``weights``,
    repeating. A quota is capped where the level (words for each unit of weight) is above its cap over its weight; each
    round raises the level by what the capped ones leave, until no further source is capped.
    """
    cycle = F.array(*map(F.lit, map(float, weights)))
    weighed = running_sums(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}).withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int"))).drop("rank")
    weighed = weighed.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    level, capped = 0.0, -1
    while True:
        under = F.col("cap") / F.col("weight") < level
        n, taken, free = weighed.agg(F.count_if(under), F.sum(F.when(under, F.col("cap"))), F.sum(F.when(~under, F.col("weight")))).first()
        if not free or n == capped:
            return weighed.withColumn("target", F.when(under, F.col("cap")).otherwise(F.col("weight") * level)).drop("weight", "cap")
        level, capped = (share * whole - (taken or 0.0)) / free, n


def route(patterns: dict, targets: dict, members: dict, most: int = MOST_REPEATS) -> dict:
    """Words that each pattern gives to each of its sources, {pattern: {source: words}}, cheapest in repetition.

    ``patterns`` has sizes, ``targets`` the sources' quotas, ``members`` each pattern's sources. All paths that use no
    copy cost nothing, those that begin with a first copy cost 1, and so on; so maximum flows with one further copy at a
    time are the successive cheapest paths.
    """
    place = {s: 2 + len(patterns) + i for i, s in enumerate(targets)}
    net = Network(2 + len(patterns) + len(targets))
    arcs = {(p, s): net.add(2 + i, place[s], most * patterns[p]) for i, p in enumerate(patterns) for s in members[p]}
    for s, t in targets.items():
        net.add(place[s], 1, round(t))
    for _ in range(most):
        for i, p in enumerate(patterns):
            net.add(0, 2 + i, patterns[p])
        net.saturate(0, 1)
    gives: dict = {p: {} for p in patterns}
    for (p, s), e in arcs.items():
        if net.cap[e + 1]:
            gives[p][s] = net.cap[e + 1]
    return gives


def _amounts(links: DataFrame, most: int) -> DataFrame:
    """pattern, amount: the cheapest flow from patterns to quotas, from checkpointed links (pattern, size, source as
    text, target, alone).

    Components of patterns that share sources need each other's flow only, so they are dealt to batches of about
    ``BATCH_LINKS`` links by a hash of their root, and a batch is one network. Patterns and sources that have each other
    only (``alone``) are components by themselves.
    """
    n_links, n_shared = links.agg(F.count(F.lit(1)), F.count_if(~F.col("alone"))).first()
    root = F.xxhash64(F.lit(1), "pattern")
    if n_shared:
        ends = links.where(~F.col("alone")).select("source", root.alias("a"), F.xxhash64(F.lit(2), "source").alias("b"))
        roots = components(ends.select("a", "b"))
        of_source = ends.select("source", "b").distinct().join(roots, F.col("b") == F.col("v"), "left").select("source", F.coalesce("root", "b").alias("root"))
        links, root = links.join(of_source, "source", "left"), F.coalesce("root", root)
    batch = F.pmod(root, F.lit(max(1, -(-n_links // BATCH_LINKS))))

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pattern", "source"])  # whatever order they came in
        sizes = dict(zip(rows["pattern"], rows["size"].astype(int), strict=True))
        targets = dict(zip(rows["source"], rows["target"], strict=True))
        gives = route(sizes, targets, rows.groupby("pattern", sort=False)["source"].apply(list).to_dict(), most)
        return pd.DataFrame([(p, sum(g.values())) for p, g in gives.items()], columns=["pattern", "amount"])

    dealt = links.select("pattern", "size", "source", "target", batch.alias("batch"))
    return dealt.groupBy("batch").applyInPandas(solved, "pattern string, amount long")


def mix(docs: DataFrame, members: Column, size: Column, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, members, size, source_sizes, targets, taken: what the mix takes of each document.

    ``members`` is an array of the sources of a document (null elements allowed), ``size`` its words.
    """
    # lean rows, read again below: texts are split once; patterns compare as text because members may be null
    told = docs.select("doc_id", F.array_sort(F.array_distinct(members)).alias("members"), size.alias("size"))
    as_text = F.to_json(F.struct("members"), {"ignoreNullFields": "false"})
    rows = cut_lineage(told.select("doc_id", "members", "size", as_text.alias("pattern")))
    patterns = cut_lineage(rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("whole"), F.count(F.lit(1)).alias("n")))
    belongs = patterns.select("pattern", "whole", F.posexplode("members").alias("at", "source"))
    sources = belongs.groupBy("source").agg(F.sum("whole").alias("source_size"), F.count(F.lit(1)).alias("shared"))
    whole, n_patterns = patterns.agg(F.coalesce(F.sum("whole"), F.lit(0)), F.count(F.lit(1))).first()
    targets = with_targets(sources, whole, weights, share, most).withColumnRenamed("source", "__source")
    links = cut_lineage(belongs.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source"))
    of_pattern = links.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("at", "source_size", "target"))).alias("s"), F.max("shared").alias("shared"))
    plan = patterns.join(of_pattern, "pattern", "left")
    alone = (F.size("s") == 1) & (F.col("shared") == 1)
    as_source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    by_pattern = links.drop("shared").join(plan.select("pattern", alone.alias("alone")), "pattern")
    by_pattern = cut_lineage(by_pattern.select("pattern", F.col("whole").alias("size"), as_source.alias("source"), "target", "alone"))
    plan = plan.join(_amounts(by_pattern, most), "pattern", "left")
    lists = [F.coalesce(F.col(f"s.{c}"), F.array().cast(f"array<{t}>")).alias(name) for c, t, name in (("source_size", "bigint", "source_sizes"), ("target", "double", "targets"))]
    plan = cut_lineage(plan.select("pattern", F.greatest(F.lit(1), F.floor(F.col("n") / BUCKET_ROWS)).alias("buckets"), "whole", F.coalesce("amount", F.lit(0)).alias("amount"), *lists))
    held = F.broadcast if n_patterns <= BROADCAST_PATTERNS else (lambda df: df)

    known = rows.join(held(plan.select("pattern", "buckets")), "pattern")
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("buckets"))
    known = known.select("doc_id", "members", "size", "pattern", spread.alias("bucket"), F.xxhash64(F.lit(seed + 1), "doc_id").alias("spot"))

    sums = known.groupBy("pattern", "bucket").agg(F.sum("size").alias("sum"))
    ahead = sums.select("pattern", "bucket", (F.sum("sum").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("sum")).alias("ahead"))
    before = Window.partitionBy("pattern", "bucket").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0))).join(ahead, ["pattern", "bucket"])
    placed = placed.join(held(plan.drop("buckets")), "pattern")
    # copy r of a pattern covers [r * whole, (r + 1) * whole) of its amount; a document takes what falls on its own part
    start = F.col("ahead") + F.col("inside")
    part = lambda r: F.greatest(F.lit(0), F.least(F.col("size"), F.col("amount") - F.lit(r) * F.col("whole") - start))
    taken = sum((part(r) for r in range(1, most)), part(0))
    return placed.select("doc_id", "members", "size", "source_sizes", "targets", taken.cast("long").alias("taken"))


def mix_by_source(docs: DataFrame, **options) -> DataFrame:
    """The mix of a table whose documents have one source each: doc_id, size, source_size, target, taken."""
    mixed = mix(docs, F.array("source"), size_of(F.col("text")), **options)
    return mixed.select("doc_id", "size", F.get("source_sizes", F.lit(0)).alias("source_size"), F.get("targets", F.lit(0)).alias("target"), "taken")
