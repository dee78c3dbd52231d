"""SimHash near-duplicates: fingerprints, a binary trie self-join under a Hamming budget, connected components.

How the join is spread: fingerprints within two bits of each other agree on at least two of four 16-bit blocks, so each
distinct fingerprint is dealt out under its six pairs of blocks, and every group of equal pairs is joined with itself
by walking pairs of nodes of its binary trie. Exact copies have been folded into one fingerprint before, so a group of
copies of any size costs one row. A key held by more than ``LARGE`` distinct fingerprints is dealt out again, by six of
eight blocks (two differing bits spoil two blocks at most); those keys fix 48 bits, so no group can ever exceed 65,536
fingerprints. Nothing is capped and no link between components is lost: a group returns edges to the least member of
each of its local components, which keeps connectivity with output no longer than the group.

The pipeline's stage looks for near copies (five-word shingles, a similarity of 0.8 or more), which lie further apart
than the two bits that equal blocks can promise. Its fingerprints have 256 bits, where a similarity of 0.8 shows as about
39 differing bits; ``NEAR_BUDGET`` bits link. Six keys of three least shingle hashes each deal the fingerprints out (two
texts of similarity 0.8 share one with probability 0.99), and the same trie join runs under each key. Of a key with
more than ``LARGE_KEY`` fingerprints no task sees all: sampled leaders settle its dense balls, and pairs of cells of the
rest are walked in tasks of their own (``_hot_key_edges``), with the same components as in one task.

Defined results: a null, empty or blank text has the fingerprint zero and links like any other; repeated rows are
copies; a null doc_id counts only where its whole component has none; an empty table gives no rows; a very long text is
hashed whole, at 8 bytes a word; ties don't arise, since a bit is 1 only if set in over half of the hashes; columns
beside doc_id and text are ignored by the query and kept by the stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage
from spanwise.llm.common import bounded_batches, fresh, row_keys, without

SHINGLE, SEED, BUDGET, LARGE = 3, 42, 2, 4000
NEAR_SHINGLE, NEAR_BUDGET, NEAR_BITS, LARGE_KEY = 5, 42, 256, 20_000
BANDS, BAND_ROWS = 6, 3
CELL, LEADERS = 4000, 1024
EDGES = "array<struct<a:binary,b:binary>>"


def _shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; of the whole sequence where there are fewer words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: lowers A-Z only and splits at \x20 and \x09-\x0D only
    if not words:
        return np.empty(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return ones


def fingerprint_of(text: str | None, width: int = SHINGLE) -> int:
    hashes = _shingle_hashes(text, width)
    return int.from_bytes(np.packbits(2 * _bit_counts(hashes) > len(hashes)).tobytes(), "big") if len(hashes) else 0


def _scrambled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Other 64 bits of each hash for every n > 0, by an odd multiple and two shifts; the hash itself for 0."""
    if not n:
        return hashes
    x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def near_fingerprint_of(text: str | None) -> tuple[bytes, list[int]]:
    """The wide fingerprint of a text's distinct shingles, and a signed key for each band of least hashes."""
    hashes = np.unique(_shingle_hashes(text, NEAR_SHINGLE))
    if not len(hashes):
        return bytes(NEAR_BITS // 8), [0]
    bits = [np.packbits(2 * _bit_counts(_scrambled(hashes, n)) > len(hashes)).tobytes() for n in range(NEAR_BITS // 64)]
    least = [int(_scrambled(hashes, 100 + n).min()) for n in range(BANDS * BAND_ROWS)]
    bands = [np.array([band, *least[band * BAND_ROWS : (band + 1) * BAND_ROWS]], np.uint64) for band in range(BANDS)]
    return b"".join(bits), [xxhash.xxh64_intdigest(band.tobytes(), SEED) - (1 << 63) for band in bands]


def fingerprint(text: Column) -> Column:
    """The 64 bits as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def trie_walk(values: np.ndarray, budget: int = BUDGET, settled=lambda a, b, c, d: False, second: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of distinct rows of uint64 words in ascending order that differ in ``budget`` bits at most.
    With ``second``, rows before it and rows from it on are two tries, each in ascending order, and pairs have one of each.

    The sorted rows are the trie: a node is a range that shares a prefix, its children lie either side of the first
    row with the next bit set. Pairs of nodes go down together, and a pair whose prefixes already differ in more bits
    than the budget is dropped, as is one that ``settled`` (first node's range, second's) says needs no more links. Small
    pairs of nodes are compared directly.
    """
    last = 64 * values.shape[1]
    todo = [(0, len(values), 0, len(values), 0, 0) if second is None else (0, second, second, len(values), 0, 0)]
    while todo:
        a, b, c, d, bit, used = todo.pop()
        n, m = b - a, d - c
        if n == 0 or m == 0 or used > budget or settled(a, b, c, d):
            continue
        if n * m <= 4096 or bit == last:
            apart = np.bitwise_count(values[a:b, None] ^ values[None, c:d]).sum(axis=2, dtype=np.int16)
            i, j = np.nonzero(apart <= budget)
            i, j = i + a, j + c
            yield (i[i < j], j[i < j]) if a == c else (i, j)
            continue
        word, mask = bit // 64, np.uint64(1 << (63 - bit % 64))
        mid = a + int(np.searchsorted((values[a:b, word] & mask) != 0, True))
        mid2 = mid if a == c else c + int(np.searchsorted((values[c:d, word] & mask) != 0, True))
        todo.append((a, mid, mid2, d, bit + 1, used + 1))
        if a != c:
            todo.append((mid, b, c, mid2, bit + 1, used + 1))
        todo += [(a, mid, c, mid2, bit + 1, used), (mid, b, mid2, d, bit + 1, used)]


def trie_links(values: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """All links of ``trie_walk`` over uint64 values or rows of them, as two rows of indices."""
    found = [np.stack(x) for x in trie_walk(values.reshape(len(values), -1), budget)]
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)


def local_roots(values: np.ndarray, budget: int = BUDGET, root: np.ndarray | None = None, second: int | None = None) -> np.ndarray:
    """The least index of each row's local component; node pairs inside one component aren't walked any further.
    ``root`` tells what is connected beforehand; ``second`` is as in ``trie_walk``."""
    root = np.arange(len(values)) if root is None else root

    def settled(a: int, b: int, c: int, d: int) -> bool:
        return b - a > 1 and (root[a:b] == root[a]).all() and (root[c:d] == root[a]).all()

    for i, j in trie_walk(values, budget, settled, second):
        x, y = root[i], root[j]
        merge = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)])[:, x != y], axis=1)
        if merge.shape[1]:
            up: dict[int, int] = {}

            def top(v: int, up: dict[int, int] = up) -> int:
                while v in up:
                    v = up[v]
                return v

            for x, y in merge.T.tolist():
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            table = np.arange(len(root))
            for v in up:
                table[v] = top(v)
            root = table[root]
    return root


def local_edges(values: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member of its local component) for members that aren't the least, as indices."""
    root = local_roots(values, budget)
    member = np.nonzero(root != np.arange(len(root)))[0]
    return member, root[member]


def _block_keys(fp: Column, blocks: int, equal: int) -> Column:
    """One key for each way in which ``equal`` of the blocks agree: which way it is, then the agreeing bits."""
    width = 64 // blocks
    masks = [sum(((1 << width) - 1) << (width * i) for i in chosen) for chosen in combinations(range(blocks), equal)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("way"), fp.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)]))


def _joined(keyed: DataFrame) -> DataFrame:
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def group_edges(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            values = np.sort(np.asarray(g, dtype=np.int64).view(np.uint64))
            members, roots = (values[x].view(np.int64).tolist() for x in local_edges(values.reshape(-1, 1)))
            out.append([{"a": a, "b": b} for a, b in zip(members, roots, strict=True)])
        return pd.Series(out)

    groups = keyed.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.explode(group_edges("fps")).alias("e")).select("e.a", "e.b")


def _as_rows(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)


def near_copy_edges(fps: DataFrame, large: int = LARGE_KEY, budget: int = NEAR_BUDGET) -> DataFrame:
    """Edges (a, b) that connect what is near under a common key; ``fps`` holds wide fingerprints in ``fp`` and their
    ``keys``, and one fingerprint may have several rows of keys."""
    keyed = fps.select("fp", F.explode(F.array_distinct("keys")).alias("key"))
    counts = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))

    @F.pandas_udf(EDGES)
    def group_edges(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            ordered = sorted(map(bytes, g))
            members, roots = local_edges(_as_rows(ordered), budget)
            out.append([{"a": ordered[i], "b": ordered[j]} for i, j in zip(members.tolist(), roots.tolist(), strict=True)])
        return pd.Series(out)

    groups = keyed.join(counts.where(F.col("n") <= large), "key").groupBy("key").agg(F.collect_set("fp").alias("fps"))
    found = groups.select(F.explode(group_edges("fps")).alias("e")).select("e.a", "e.b")
    hot = counts.where(F.col("n") > large)
    if hot.isEmpty():
        return found.distinct()
    return found.unionByName(_hot_key_edges(keyed.join(hot, "key"), budget)).distinct()


def _hot_key_edges(members: DataFrame, budget: int) -> DataFrame:
    """Edges that connect the near copies under keys too large for one task; ``members`` holds fp, key and n.

    First every member is compared with its key's leaders, drawn by a hash, about one for ``CELL`` members: a dense ball
    settles here. Members near a leader form cells around it, the others loose cells, each of about ``CELL``; then pairs
    of cells are walked, each pair a row of its own. Two cells around leaders that are connected already need no walk,
    nor do two whose leaders are more than three budgets apart, which no link can bridge. All other pairs are walked, so
    nothing is lost; what is sparse under one key costs the square of its size over the cores.
    """
    cell = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / CELL))
    cells = members.groupBy("key", cell.alias("cell")).agg(F.collect_set("fp").alias("fps"))
    drawn = members.where(F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.col("n")) < F.least(F.lit(LEADERS), F.ceil(F.col("n") / CELL)))
    lead = drawn.groupBy("key").agg(F.collect_set("fp").alias("leaders"))

    @F.pandas_udf(f"placed array<struct<fp:binary,home:binary>>, ties {EDGES}")
    def compare(groups: pd.Series, chosen: pd.Series) -> pd.DataFrame:
        rows = []
        for g, of in zip(groups, chosen, strict=True):
            g, of = list(map(bytes, g)), sorted(map(bytes, of))
            placed, ties, leaders = [], set(), _as_rows(of)
            for i in range(0, len(g), 256):
                part = g[i : i + 256]
                apart = np.bitwise_count(_as_rows(part)[:, None] ^ leaders[None, :]).sum(axis=2, dtype=np.int16)
                for fp, row in zip(part, apart, strict=True):
                    near = np.flatnonzero(row <= budget).tolist()
                    home = of[min(near, key=row.__getitem__)] if near else None
                    placed.append({"fp": fp, "home": home})
                    ties.update((of[k], home) for k in near if of[k] != home)
            rows.append((placed, [{"a": a, "b": b} for a, b in sorted(ties)]))
        return pd.DataFrame(rows, columns=["placed", "ties"])

    none = F.array().cast("array<binary>")
    seen = cut_lineage(cells.join(lead, "key", "left").select("key", compare("fps", F.coalesce("leaders", none)).alias("s")))
    placed = seen.select("key", F.explode("s.placed").alias("p")).select("key", "p.fp", "p.home")
    ties = seen.select(F.explode("s.ties").alias("e")).select("e.a", "e.b").distinct()
    stars = placed.where("fp <> home").select(F.col("fp").alias("a"), F.col("home").alias("b"))
    roots = components(ties).select(F.col("v").alias("home"), "root")

    sizes = placed.groupBy("key", "home").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.join(roots, "home", "left").select(F.col("key").alias("k"), F.col("home").alias("h"), "m", F.coalesce("root", "home").alias("root"))
    known = placed.join(sizes, (F.col("key") == F.col("k")) & F.col("home").eqNullSafe(F.col("h")))
    piece = F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.ceil(F.col("m") / CELL))
    cells = known.groupBy("key", "home", "root", piece.alias("piece")).agg(F.collect_set("fp").alias("fps"))
    name = F.concat_ws("/", F.coalesce(F.hex("home"), F.lit("")), "piece")
    cells = cut_lineage(cells.select("key", name.alias("cell"), "home", "root", "fps"))

    @F.pandas_udf("boolean")
    def bridged(a: pd.Series, b: pd.Series) -> pd.Series:
        far = lambda x, y: x is not None and y is not None and (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count() > 3 * budget
        return pd.Series([not far(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    @F.pandas_udf(EDGES)
    def walk(a: pd.Series, b: pd.Series, a_home: pd.Series, b_home: pd.Series, same: pd.Series) -> pd.Series:
        out = []
        for x, y, x_home, y_home, once in zip(a, b, a_home, b_home, same, strict=True):
            x, y = sorted(map(bytes, x)), [] if once else sorted(map(bytes, y))
            both, first = x + y, np.arange(len(x) + len(y))
            if x_home is not None:
                first[: len(x)] = 0
            if y_home is not None:
                first[len(x) :] = len(x)
            root = local_roots(_as_rows(both), budget, first, None if once else len(x))
            out.append([{"a": both[i], "b": both[root[i]]} for i in np.unique(first).tolist() if root[i] != i])
        return pd.Series(out)

    meta = cells.select("key", "cell", "home", "root")
    other = meta.toDF("key", "cell2", "home2", "root2")
    open_ = F.coalesce(F.col("root") != F.col("root2"), F.lit(True)) & ((F.col("cell") < F.col("cell2")) | ((F.col("cell") == F.col("cell2")) & F.col("home").isNull()))
    pairs = cut_lineage(meta.join(other, "key").where(open_).where(bridged("home", "home2")).select("key", "cell", "cell2"))
    pairs = pairs.join(cells.select("key", "cell", "home", "fps"), ["key", "cell"])
    pairs = pairs.join(cells.select("key", F.col("cell").alias("cell2"), F.col("home").alias("home2"), F.col("fps").alias("fps2")), ["key", "cell2"])
    found = pairs.select(F.explode(walk("fps", "fps2", "home", "home2", F.col("cell") == F.col("cell2"))).alias("e")).select("e.a", "e.b")
    return stars.unionByName(ties).unionByName(found)


def near_edges(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """Edges (a, b) that connect what lies within two bits; ``fps`` holds distinct fingerprints in ``fp``."""
    keyed = fps.select("fp", _block_keys(F.col("fp"), 4, 2).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(counts, "key")
    hot = shared.where(F.col("n") > large).select("fp").distinct()
    again = hot.select("fp", _block_keys(F.col("fp"), 8, 6).alias("key"))
    return _joined(shared.where(F.col("n") <= large)).unionByName(_joined(again)).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root): the least vertex of each component, for vertices that have an edge.

    Alternates large-star and small-star steps, each a groupBy and a join, until the edges form stars; every round is
    checkpointed, so the plan stays short and a lost executor costs one round. Rounds grow with the logarithm of the
    longest chain; ``most_rounds`` stops what could only be a fault.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut_lineage(small.select("e.a", "e.b").where("a <> b").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach)."""
    marked = cut_lineage(bounded_batches(docs).select("doc_id", fingerprint(F.col("text")).alias("fp")))
    return component_ids(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def component_ids(marked: DataFrame, by: str = "doc_id", keys: str | None = None) -> DataFrame:
    """Adds component_id, the least ``by`` of a component, to rows with fp; ``keys`` names the column that deals wide
    fingerprints out. Joins are on fp, where a hot copy group is split by adaptive execution."""
    least = cut_lineage(marked.groupBy("fp").agg(F.min(by).alias("low")))
    # different texts may agree in their wide fingerprint and not in their keys: all keys are dealt
    stars = components(near_copy_edges(marked.select("fp", F.col(keys).alias("keys")).distinct()) if keys else near_edges(least.select("fp")))
    linked = stars.select(F.col("v").alias("fp"), "root").unionByName(stars.select(F.col("root").alias("fp"), "root").distinct())
    of_root = linked.join(least, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    # only what is linked has a root: the others would all meet under its absence
    found = linked.join(of_root, "root").select("fp", "component_id")
    ids = least.join(found, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return marked.join(ids, "fp", "left")


def near_fingerprint(text: Column) -> Column:
    @F.pandas_udf("fp binary, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([near_fingerprint_of(t) for t in texts], columns=["fp", "keys"])

    return of(text)


def near_copies(docs: DataFrame) -> DataFrame:
    """row (without_id, id, k1, k2) of each document and component_id, the least row of its group of near copies."""
    row = F.struct(F.col("doc_id").isNull().alias("without_id"), F.col("doc_id").alias("id"), *row_keys(F.col("doc_id"), F.col("text")))
    marked = bounded_batches(docs).select(row.alias("row"), near_fingerprint(F.col("text")).alias("f"))
    return component_ids(cut_lineage(marked.select("row", "f.fp", "f.keys")), "row", "keys").select("row", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id; columns stay as they are.

    A document is a doc_id and a text: rows that repeat both stay once, an id with texts in several groups stays
    with one text in each. Ids that are null come last, and of equal ids the text with the least hash stays.
    """
    k1, k2 = row_keys(docs["doc_id"], docs["text"])
    marked = cut_lineage(near_copies(docs))
    gone = marked.where("row <> component_id").select("row.k1", "row.k2")
    repeated = marked.groupBy("row.k1", "row.k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    a, b = fresh(docs, "k1"), fresh(docs, "k2")
    keyed = docs.withColumns({a: k1, b: k2})
    kept = without(keyed, gone.toDF(a, b), [a, b])
    repeated = cut_lineage(repeated.select(F.col("k1").alias("__r1"), F.col("k2").alias("__r2")))
    if not repeated.isEmpty():
        again = (kept[a] == repeated["__r1"]) & (kept[b] == repeated["__r2"])
        once = kept.join(repeated, again, "left_semi").dropDuplicates([a, b])
        kept = kept.join(repeated, again, "left_anti").unionByName(once)
    return kept.drop(a, b)
