"""Filter interaction audit: what each of five filters removes in every order that they may be applied in.

Each document's failures are five bits, made of native expressions over its whole text; whether it repeats the text of a
smaller doc_id comes from a grouping by text, which supplies the least doc_id. What the filters do to each other depends
on the mask alone, so a part of the corpus is described by 32 cells (how many documents have each mask, how many of these
are good or toxic), and all 120 orders are read off the cells.

Texts are grouped by their SHA-256, which moves 32 bytes in place of a text. Copies are counted by (digest, part, labels)
before they meet, which combines on the map side: a text that a third of the corpus repeats leaves a row for each part and
labels, and no document is joined back to its group. Only (doc_id, labels) meet by a join, on a key of its own for each
document.

Defined results: a null text is the empty text; empty texts have no words, so fail A alone, and E as copies of each other;
a null doc_id is smaller than none and has nothing smaller, so never fails E, and has no labels; rows that share id and
text aren't smaller than each other; a null source counts as the empty string; labels that repeat count once, and one that
says 1 is enough; parts without documents have no rows, so an empty table gives none; other columns are left out, whatever
their names.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
COPY = BIT["E"]
SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"


def _let(value: Column, then) -> Column:
    """Evaluates an expression once and hands it to ``then`` as a variable."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def text_mask(text: Column) -> Column:
    """The bits of filters A to D for a text that isn't null."""
    bit = lambda name, fails: F.when(fails, F.lit(BIT[name])).otherwise(F.lit(0))
    words = F.array_remove(F.split(text, SPACES), "")
    counted = _let(words, lambda w: bit("A", F.size(w) < MIN_WORDS) + bit("B", 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w)))
    n = F.length(text).cast("long")
    upper = n - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return counted + bit("C", 100 * upper > MAX_UPPER_PERCENT * n) + bit("D", text.rlike(SYMBOLS))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part by the filters that they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    # nulls match no label, so they are kept out of the join, where they would all be one key
    known = rows.where("doc_id is not null").join(said, "doc_id", "left").fillna(0, ["good", "toxic"])
    known = known.select(*rows.columns, "good", "toxic").unionByName(rows.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    alike = ["digest", "part", "mask", "good", "toxic"]
    each = known.groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    without_id = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    copies = each.groupBy(*alike).agg(F.sum("n").alias("n"), without_id.alias("without_id"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    # a row for each (part, labels) of a text here, however many copies it has
    least = F.min("least").over(Window.partitionBy("digest"))
    stays = F.col("without_id") + F.when(F.col("least") == least, F.col("n_least")).otherwise(0)
    split = copies.select("part", "mask", "good", "toxic", "n", stays.alias("stays"))
    sides = F.explode(F.array(F.struct(F.col("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("stays")).alias("n"))))
    cells = split.select("part", "good", "toxic", sides.alias("c")).groupBy("part", "c.mask")
    return cells.agg(F.sum("c.n").alias("n"), *[F.sum(F.col(c) * F.col("c.n")).alias(c) for c in ("good", "toxic")])


def orders() -> list[tuple[str, int, int, int]]:
    """filter_order, step, the step's bit and the bits of the filters before it: a fixed list of 600."""
    out = []
    for order in itertools.permutations(FILTERS):
        for i, name in enumerate(order):
            out.append(("".join(order), i + 1, BIT[name], sum(BIT[x] for x in order[:i])))
    return out


def over_orders(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step, summed over the part's cells (32 at most)."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "bit", "before"), x, strict=True)) for x in orders()])), "array<struct<filter_order string, step int, bit int, before int>>")
    rows = parts.select("*", F.inline(steps))
    fails = lambda x: x["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda x: x["mask"].bitwiseAND(F.col("before")) != 0
    none = F.lit(0).cast("long")

    def total(test, what: str = "n", times=lambda x: F.lit(1)) -> Column:
        return F.aggregate("cells", none, lambda s, x: s + F.when(test(x), x[what] * times(x)).otherwise(none))

    first = lambda x: fails(x) & ~gone(x)
    # of the orders of k failed filters, each of these comes first in one of k
    n_orders = F.lit(len(list(itertools.permutations(FILTERS)))).cast("long")
    share = lambda x: F.floor(n_orders / F.bit_count(x["mask"]))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda x: ~fails(x) & ~gone(x)).alias("kept"),
        total(first).alias("removed"),
        total(lambda x: fails(x) & gone(x)).alias("redundant"),
        total(lambda x: x["mask"] == F.col("bit")).alias("unique_fails"),
        total(first, "good").alias("good_lost"),
        total(first, "toxic").alias("toxic_lost"),
        total(fails, "n", share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return over_orders(mask_cells(docs, labels))
