import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from spanwise.llm import simhash
from spanwise.llm.common import table
from tests.llm.helpers import edge_docs, rows


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """pairs: (doc_id, fingerprint); the least doc_id reachable for each position."""
    root = list(range(len(pairs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 2:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        ids = least.setdefault(top(i), [])
        ids += [d] if d is not None else []
    return [min(least[top(i)], default=None) for i in range(len(pairs))]


def check(docs):
    pairs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(pairs, plain_components(pairs), strict=True)), key=str)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(simhash.simhash_components(docs))), key=str)
    assert got == want


def test_against_brute_force(spark, small):
    check(table(spark, small, "documents"))
    check(edge_docs(spark))
    check(table(spark, small, "documents").limit(0))


@given(st.integers(0, 5), st.integers(2, 400), st.integers(0, 20))
def test_trie_finds_every_link(seed, n, spread):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)
    flips = sum((np.uint64(1) << rng.integers(0, 64 - spread, n, dtype=np.uint64)) for _ in range(2))
    values = np.unique(base[rng.integers(0, len(base), n)] ^ flips)
    i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2, 1))
    assert set(map(tuple, simhash.trie_links(values).T.tolist())) == set(zip(i.tolist(), j.tolist(), strict=True))


def test_dense_node_pairs():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 14, 6000).astype(np.uint64))
    i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2, 1))
    assert set(map(tuple, simhash.trie_links(values).T.tolist())) == set(zip(i.tolist(), j.tolist(), strict=True))


def test_large_keys_lose_nothing(spark):
    rng = np.random.default_rng(3)
    values = sorted({int(x) for x in (rng.integers(0, 2**20, 300) << 30)} | {int(x) << 12 for x in range(200)} | {0, 2**62})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    want = plain_components([(v, v) for v in values])
    for large in (2, 4000):
        found = {r["v"]: r["root"] for r in simhash.components(simhash.near_edges(fps, large)).collect()}
        assert [found.get(v, v) for v in values] == want


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    found = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 1001: 1000}


def test_one_document_of_each_stays(spark):
    docs = edge_docs(spark)
    kept = rows(simhash.keep_one_of_each(docs))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1, 4, 5, 6, 7, 8, 9, 11, 12]
    assert list(kept[0]) == docs.columns


def test_rows_stay_by_id_and_text(spark):
    one = "the quick brown fox jumps over the lazy dog"
    docs = [
        (None, "first text that nobody else has written down"), (None, "second and unrelated words about something"), (None, one), (7, one),
        (3, "zebra stripes are black and white in the sun"), (3, "completely different story of a ship at sea"), (2, "completely different story of a ship at sea"),
        (5, "kept twice only once in the end"), (5, "kept twice only once in the end"), (None, "no id twice here"), (None, "no id twice here"),
    ]
    kept = simhash.keep_one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    want = [docs[0], docs[1], docs[3], docs[4], docs[6], docs[7], docs[9]]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    # an id with two texts, one of them in a component with a smaller id and the other alone
    texts = [(9, "alone in its component as it is"), (9, "shared by two ids in the table"), (8, "shared by two ids in the table")]
    got = simhash.keep_one_of_each(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [texts[2], texts[0]]


def plain_near_fingerprint(text):
    """The distinct five-word shingles' 256 bits, one bit at a time."""
    words = (text or "").encode().lower().split()
    grams = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    out = 0
    for n in range(4):
        for h in range(64):
            ones = 0
            for x in hashes:
                if n:
                    x = x * (0x9E3779B97F4A7C15 + 2 * n) % 2**64
                    x = (x ^ x >> 32) * 0xBF58476D1CE4E5B9 % 2**64
                    x ^= x >> 29
                ones += x >> h & 1
            out |= (2 * ones > len(hashes)) << (64 * (3 - n) + h)
    return out


def plain_groups(fps, budget):
    """The least index of each one's component over all pairs."""
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(fps))]


def test_near_copies_against_brute_force(spark, small):
    docs = table(spark, small, "documents")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    fps = [plain_near_fingerprint(t) for _, t in texts]
    assert all(int.from_bytes(simhash.near_fingerprint_of(t)[0], "big") == f for (_, t), f in zip(texts, fps, strict=True))
    kept = {texts[r][0] for r in plain_groups(fps, simhash.NEAR_BUDGET)}
    assert {r["doc_id"] for r in rows(simhash.keep_one_of_each(docs))} == kept


def test_near_copies_of_similarity_above_four_fifths_are_found(spark):
    """Recall over pairs, against all pairs that share a shingle."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    shingles, held = {}, {}
    for r in docs.select("doc_id", "text").collect():
        w = (r["text"] or "").lower().split()
        shingles[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for g in shingles[r["doc_id"]]:
            held.setdefault(g, []).append(r["doc_id"])
    pairs = {(a, b) for ids in held.values() if len(ids) <= 50 for a in ids for b in ids if a < b}
    similarity = {(a, b): len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) for a, b in pairs}
    group = {r["row"]["id"]: r["component_id"]["id"] for r in rows(simhash.near_copies(docs))}
    near = [p for p, s in similarity.items() if s >= 0.8]
    assert len(near) > 20 and sum(group[a] == group[b] for a, b in near) >= 0.9 * len(near)
    grouped = {d for d, g in group.items() if d != g} | {g for d, g in group.items() if d != g}
    most = {}
    for (a, b), s in similarity.items():
        most[a], most[b] = max(most.get(a, 0), s), max(most.get(b, 0), s)
    assert all(most.get(d, 0) > 0.5 or not shingles[d] for d in grouped)  # clean documents stay


def test_a_key_that_very_many_share(spark):
    """A ball of copies of one text, a second ball and strangers, all under one key: cells, leaders and rounds."""
    rng = np.random.default_rng(4)
    def ball(centre, n):
        out = set()
        for _ in range(n):
            x = centre
            for bit in rng.choice(256, 15, replace=False).tolist():
                x ^= 1 << bit
            out.add(x)
        return sorted(out)
    draw = lambda: int.from_bytes(rng.bytes(32), "big")
    one, two, alone = ball(draw(), 700), ball(draw(), 300), [draw() for _ in range(400)]
    values = sorted({*one, *two, *alone})
    fps = spark.createDataFrame([(v.to_bytes(32, "big"), [7, 7]) for v in values], "fp binary, keys array<long>")
    want = plain_groups(values, simhash.NEAR_BUDGET)
    for large in (100, 20_000):
        found = {r["v"]: r["root"] for r in simhash.components(simhash.near_copy_edges(fps, large)).collect()}
        got = [int.from_bytes(found.get(v.to_bytes(32, "big"), v.to_bytes(32, "big")), "big") for v in values]
        assert got == [values[i] for i in want], large


def check_cells(spark, values, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    fps = spark.createDataFrame([(v.to_bytes(32, "big"), [7, 7]) for v in values], "fp binary, keys array<long>")
    want = plain_groups(values, simhash.NEAR_BUDGET)
    for large in (100, 20_000):
        found = {r["v"]: r["root"] for r in simhash.components(simhash.near_copy_edges(fps, large)).collect()}
        got = [int.from_bytes(found.get(v.to_bytes(32, "big"), v.to_bytes(32, "big")), "big") for v in values]
        assert got == [values[i] for i in want], large
    return len(set(want))


@pytest.mark.parametrize("cell", [40, 300])
def test_sparse_links_under_a_hot_key(spark, monkeypatch, cell):
    """Members some 40 bits apart, of which only some pairs link: leaders alone lose links here."""
    rng = random.Random(6)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(256)
        for _ in range(70):
            x = centre
            for bit in rng.sample(range(256), rng.randint(26, 32)):
                x ^= 1 << bit
            values.add(x)
    groups = check_cells(spark, sorted(values), monkeypatch, cell)
    assert 12 < groups < len(values)


def test_chains_under_a_hot_key(spark, monkeypatch):
    """Chains of links that wander from one leader's ball to the next."""
    rng = random.Random(8)
    values = set()
    for _ in range(6):
        x = rng.getrandbits(256)
        for _ in range(80):
            for bit in rng.sample(range(256), 30):
                x ^= 1 << bit
            values.add(x)
    assert check_cells(spark, sorted(values), monkeypatch, 50) == 6


def test_keys_of_texts_with_one_fingerprint(spark):
    """Two rows of one fingerprint under different keys, each of which leads to another neighbour."""
    a, b, c = (x.to_bytes(32, "big") for x in (5 << 200, 5 << 200 | 1, 5 << 200 | 1 << 60))
    marked = spark.createDataFrame([(1, a, [1]), (2, a, [2]), (3, b, [1]), (4, c, [2])], "doc_id long, fp binary, keys array<long>")
    assert {r["doc_id"]: r["component_id"] for r in rows(simhash.component_ids(marked, "doc_id", "keys"))} == dict.fromkeys((1, 2, 3, 4), 1)


@given(st.integers(0, 5), st.integers(2, 300), st.integers(1, 40))
def test_local_components_of_wide_rows(seed, n, budget):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (max(1, n // 20), 2), dtype=np.uint64)
    flips = np.zeros((n, 2), np.uint64)
    for _ in range(12):
        flips[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    values = np.unique(base[rng.integers(0, len(base), n)] ^ flips, axis=0)
    whole = [int(a) << 64 | int(b) for a, b in values.tolist()]
    assert simhash.local_roots(values, budget).tolist() == plain_groups(whole, budget)
