"""Benchmark decontamination by winnowing, in DataFrame functions only.

A run of ``SPAN`` = 13 words holds ``WINDOW`` = 9 word 5-grams; the least of their hashes stands for the run, so two
equal runs always select the same fingerprint, and every shared run of 13 words or more is found. Documents keep the
distinct selected (hash, position) pairs, about one for five words, and look them up among the benchmark's. Only a hit
is extended: the up to nine runs of 13 words around it are compared with the benchmark's as text, which makes the
result exact whatever the hashes do. Items of fewer than 13 words are looked up whole, all lengths in one pass: only
where a document has an item's first word are the runs from there compared.

Scale: the benchmark's fingerprints and runs are broadcast while it has at most ``BROADCAST_RUNS`` runs and these take at
most ``BROADCAST_BYTES`` bytes, both measured first (a word has no length limit, so a count alone bounds nothing); beyond
that the same joins shuffle, and each fingerprint then carries the 21 words around it. A
document's words never leave its row before a fingerprint has hit, and passages that very many documents share put no
key of the documents' side into one task, as long as the benchmark's side is broadcast; otherwise adaptive execution
splits them.

Defined results: null and empty texts have no words, no hits and the digest of the empty string; repeated rows give
repeated results; rows that share a doc_id but not the text are judged apart; items without words match nothing; an item
without an id hits words but is not counted; equal hashes select the leftmost place; an empty table of documents gives
no rows, one of items no hits; a very long text is searched whole, one of more than 2**28 words fails the job; columns beside the ids and texts
are ignored by the query and kept by the pipeline's stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import ascii_lower, fresh, row_keys, without

SPAN, GRAM = 13, 5
WINDOW = SPAN - GRAM + 1
BROADCAST_RUNS, BROADCAST_BYTES = 500_000, 64 << 20
POSITION_BITS = 28
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BREAKS), ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words, without lowering the text: upper case counts as word characters instead."""
    return F.size(F.coalesce(F.array_remove(F.split(text, BREAKS_ANY_CASE), ""), F.array().cast("array<string>"))).cast("long")


def _let(value: Column, then) -> Column:
    """Evaluates an expression once and hands it to ``then`` as a variable."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def selected(words: Column) -> Column:
    """Winnowed fingerprints of a word array as longs: hash in the upper bits, position of the 5-gram in the lower 28.

    The position in the lower bits makes the leftmost of equal hashes the least one, alike in equal runs.
    """
    empty = F.array().cast("array<long>")

    def winnow(grams: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(grams) - WINDOW)
        return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(grams, i + 1, WINDOW))))

    def grams_of(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - GRAM)
        gram = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(GRAM)])
        return F.transform(starts, lambda i: F.shiftleft(gram(i), POSITION_BITS).bitwiseOR(i.cast("long")))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    too_long = F.raise_error(F.lit(f"a text of more than 2**{POSITION_BITS} words")).cast("array<long>")
    return F.when(F.size(words) > 1 << POSITION_BITS, too_long).when(F.size(words) >= SPAN, _let(hashes, lambda h: _let(grams_of(h), winnow))).otherwise(empty)


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")


def _runs_at(words: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.cast("int").alias("at"), F.array_join(F.slice(words, s + 1, n), " ").alias("run")))


def _short_spans(keyed: DataFrame, short: DataFrame, held, small: bool) -> DataFrame:
    """Places of items of fewer than ``SPAN`` words: each first word of an item that a document has is tried in full."""
    whole = short.groupBy(F.array_join("words", " ").alias("run"), F.get("words", F.lit(0)).alias("word"), F.col("n").alias("len")).agg(F.collect_set("item").alias("items"))
    firsts = whole.select("word", "len").distinct()
    places = keyed.select("k1", "k2", "words", F.posexplode("words").alias("at", "word"))
    ahead = F.slice("words", F.col("at") + 1, SPAN - 1)
    if not small:  # what is shuffled carries the words ahead only
        places = places.select("k1", "k2", "at", "word", ahead.alias("words"))
        ahead = F.col("words")
    met = places.join(held(firsts), "word").where(F.size(ahead) >= F.col("len"))
    tried = met.select("k1", "k2", "at", "len", F.array_join(F.slice(ahead, F.lit(1), F.col("len")), " ").alias("run"))
    return tried.join(held(whole.select("run", "len", "items")), ["run", "len"]).select("k1", "k2", "at", "len", "items")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For documents that are hit at all: k1, k2 (the row's keys), n_hit and the hit items' ids as strings."""
    bench = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).select("item", "words", F.size("words").alias("n"))
    n_runs, n_bytes, shortest = bench.agg(
        F.sum(F.greatest(F.col("n") - SPAN + 1, F.lit(1))),
        F.sum(F.least(F.col("n"), F.lit(SPAN)) * (F.octet_length(F.array_join("words", " ")) + 1)),  # each word lies in 13 runs at most
        F.min(F.when(F.col("n") > 0, F.col("n"))),
    ).first()
    small = (n_runs or 0) <= BROADCAST_RUNS and (n_bytes or 0) <= BROADCAST_BYTES
    held = F.broadcast if small else (lambda df: df)
    every = F.when(F.col("n") >= SPAN, F.sequence(F.lit(0), F.col("n") - SPAN)).otherwise(F.array().cast("array<int>"))
    runs = bench.where(F.col("n") >= SPAN).select("item", F.explode(_runs_at(F.col("words"), every, SPAN)).alias("r")).groupBy("r.run").agg(F.collect_set("item").alias("items"))
    marks = bench.select(F.explode(selected(F.col("words"))).alias("x")).select(F.shiftright("x", POSITION_BITS).alias("hash")).distinct()

    keyed = docs.select(*row_keys(F.col("doc_id"), F.col("text")), words_of(F.col("text")).alias("words"))
    around = F.slice("words", F.greatest(F.col("p") - (WINDOW - 1), F.lit(0)) + 1, SPAN + WINDOW - 1)
    first = F.greatest(F.col("p") - (WINDOW - 1), F.lit(0)).alias("first")
    found = keyed.select("k1", "k2", "words", F.explode(selected(F.col("words"))).alias("x"))
    found = found.select("k1", "k2", "words", F.shiftright("x", POSITION_BITS).alias("hash"), _position(F.col("x")).alias("p"))
    lean = lambda df: df.select("k1", "k2", *(["hash"] if "hash" in df.columns else []), first, around.alias("words"))
    hit = lean(found.join(held(marks), "hash").drop("hash")) if small else lean(found).join(marks, "hash")
    here = F.sequence(F.lit(0), F.size("words") - SPAN)
    spans = hit.select("k1", "k2", "first", F.explode(_runs_at(F.col("words"), here, SPAN)).alias("r"))
    spans = spans.select("k1", "k2", (F.col("first") + F.col("r.at")).alias("at"), F.lit(SPAN).alias("len"), F.col("r.run").alias("run")).join(held(runs), "run").drop("run")
    if shortest is not None and shortest < SPAN:
        spans = spans.unionByName(_short_spans(keyed, bench.where(F.col("n").between(1, SPAN - 1)), held, small))

    per_doc = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def grow(acc: Column, x: Column) -> Column:
        end = x["at"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["at"]), F.lit(0))).alias("n"))

    return per_doc.select("k1", "k2", F.aggregate("spans", start, grow)["n"].alias("n_hit"), "items")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more is hit)."""
    hits = contamination(docs, items)
    counted = docs.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), word_count(F.col("text")).alias("n_words"))
    # repeated rows have equal keys, and hits are one row for each key
    joined = counted.join(hits, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that aren't contaminated, columns as they are."""
    id_and_text = row_keys(F.col("doc_id"), F.col("text"))
    names = [fresh(docs, "k1"), fresh(docs, "k2")]
    named = docs.withColumns(dict(zip(names, id_and_text, strict=True)))
    counted = docs.select(*id_and_text, word_count(F.col("text")).alias("n_words")).join(contamination(docs, items), ["k1", "k2"])
    bad = counted.where("20 * n_hit >= n_words").select("k1", "k2").toDF(*names)
    return without(named, bad, names).drop(*names)
