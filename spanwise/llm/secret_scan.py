"""Secret scans: patterns for known kinds, and zstandard novelty primed with a dictionary for the rest.

Novelty: a candidate is a run of 16 or more secret-like characters with letters and digits. A compressor is primed with
an identifier dictionary and the text around the candidate; the bytes that the candidate adds to the compressed
surroundings say how much of it is new. Words, paths and repeated identifiers compress away; random strings don't. What
counts is the candidate's bytes over those of random strings of its length and alphabet in the same place, so a long
lower-case name isn't taken for a key nor a key of few characters for a name. What is shaped like a name (words and
numbers between separators) has to be newer still.

The dictionary is zstandard's own training over ``IDENTIFIERS`` and the words that at least ``COMMON`` different texts
share, so that its matches and its letter frequencies are those of the corpus. The words of every text are counted. The
dictionary has ``DICTIONARY_BYTES``, so of the words in order of how many texts hold them those are taught that it has
room for. Words are letters only, so no key is learned however many copies hold it.

Candidates that stay incompressible and stand in a sensitive context (one of ``CONTEXT``
within ``NEAR`` characters before them) become spans of kind ``novel``. A context reaches on over lines that directly
follow a novel one (a wrapped key), and between the markers of a private key every line of it is a span. A value that a
separator ties to a context is measured from 6 characters on, and without digits where the place tells of a value.
Spans found by pattern always stay.

One pass over the rows without a shuffle, after those that count words, in which only hashes, counts and the texts that
have copies are moved; the work for a text grows with its length, and candidates are few.

Defined results: null counts as the empty text, which has no spans; offsets are code points, ends exclusive; repeated
rows give repeated results; an empty table gives no rows; a very long text is searched whole; spans that start alike are
ordered by kind; columns beside doc_id and text are ignored by the query and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage
from spanwise.llm.common import BROADCAST_KEYS, bounded_batches, row_keys

# The patterns of the three known kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs are maximal, so shorter matches can be left out at once
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*[0-9])(?=[0-9+/_=.-]*[A-Za-z])[A-Za-z0-9+/_=.-]{16,}")
# Words that make a context sensitive.
CONTEXT = re.compile(r"(?ai)passw|passphrase|pwd|secret|token|api[_-]?key|private|credential|bearer|authori[sz]ation|access[_-]?key|signature|client[_-]?id|connection[_-]?string|session|cookie|salt")
NEAR, AROUND = 48, 256
NOVEL, NAMELIKE = 0.87, 1.12  # added bytes over those of random strings: for candidates, for what is shaped like a name
COMMON, DICTIONARY_BYTES = 3, 16_384
WORD, LEAST_WORD = re.compile("[A-Za-z]{4,24}"), 4  # what counts as a word, its least length

#: A separator and a value, where no call follows; NAMED must end at the separator.
VALUE = re.compile(r"""(?::=|=>|[:=])[\x20\t]*(?:[Bb]earer[\x20\t]+)?(["'`]?)([A-Za-z0-9+/_.=-]{6,}+)(?![(\[])""")
NAMED = re.compile(rf"""(?:{CONTEXT.pattern[5:]})[A-Za-z0-9_-]{{0,24}}["'\]]?[\x20\t]*\Z""", re.ASCII | re.IGNORECASE)
#: After these names even an unquoted word behind a colon is a value.
OUTRIGHT = re.compile(r"(?ai)passw|passphrase|pwd|credential|secret|private[_-]?key|access[_-]?key")
PRIVATE = re.compile(r"-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY[A-Z ]{0,8}-----((?:(?!-----BEGIN ).)*?)-----END ", re.DOTALL)
KEY_RUN, HEADER = re.compile(r"[A-Za-z0-9+/=]+"), re.compile(r"(?m)^[\x20\t]*[A-Za-z-]+:\x20.*$")
#: From the end of one line of a wrapped value over the next one, which stands alone; quotes and escaped breaks included.
ONWARDS = re.compile(r"""["'\\+,;\x20\t]{0,8}(?:\r?\n|\\n)["'>#*|\x20\t]{0,24}([A-Za-z0-9+/_.=-]{4,}+)(?=["'\\,;\x20\t]{0,8}(?:\r|\n|\\n|n|\Z))""")

# Identifiers that code and configuration are full of.
IDENTIFIERS = """
password passwd secret token api_key apikey access_key private_key client_id client_secret authorization bearer
session cookie signature credentials username user_name user_id config configuration settings environment variable
import export return function class public private static const let var def self this null none true false string
integer boolean float double long char byte array list dict map object value values key keys name names type types
index length size count total number default parameter parameters argument arguments option options request response
status message error exception warning debug info timeout retry connection connect host hostname port database table
column schema select insert update delete where from join group order limit http https www com org net localhost
example index.html main.py setup.py package.json application json xml yaml html css javascript python java content-type
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 1234567890 11111111 aaaaaaaa
""".strip()
PLAIN = frozenset(re.findall("[a-z]+", IDENTIFIERS))  # for values too short for the compressor to tell a match


def trained(words: list[str]) -> bytes:
    """A dictionary of zstandard's training over the identifiers and further words, the same for the same words.

    Every word is shown as often as any other, or once more.
    """
    known, rng = IDENTIFIERS.split(), random.Random(1)
    shown = itertools.chain.from_iterable(rng.sample(words, len(words)) for _ in itertools.count())
    samples = []
    for i in range(400):
        mixed = rng.choices(known, k=10) + (list(itertools.islice(shown, 30)) if words else rng.choices(known, k=30))
        samples.append("".join(w + rng.choice(" \n._/-") for w in mixed).encode())
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()


def different_texts(docs: DataFrame) -> DataFrame:
    """Each different text once. Texts whose hash no other row has stay where they are; only the others are moved."""
    texts = docs.select("text", *row_keys(F.col("text")))
    copied = cut_lineage(texts.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1"))
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_KEYS else copied
    single = texts.join(copied, "k1", "left_anti")
    return single.unionByName(texts.join(copied, "k1", "left_semi").dropDuplicates(["k1", "k2"])).select("text")


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n of each batch: how many of its texts hold the word."""
    for batch in batches:
        n: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            n.update(set(WORD.findall(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["word", "n"])


def learned(docs: DataFrame) -> bytes:
    """The dictionary of a corpus. Words are counted once for each different text, so copies teach nothing twice."""
    counts = bounded_batches(different_texts(docs)).mapInArrow(counted_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    room = DICTIONARY_BYTES // (LEAST_WORD + 1)  # no more words fit, each with a separator
    common = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "word").limit(room).collect()
    ends = itertools.accumulate(len(r["word"]) + 1 for r in common)
    return trained([r["word"] for r, end in zip(common, ends, strict=True) if end <= DICTIONARY_BYTES])


class Novelty:
    """How much of a string its surroundings and a dictionary don't tell."""

    def __init__(self, dictionary: bytes | None = None, level: int = 3):
        seen = zstandard.ZstdCompressionDict(dictionary or trained([]), dict_type=zstandard.DICT_TYPE_FULLDICT)
        seen.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(dict_data=seen, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, before: str, s: str, after: str, least: int) -> int:
        return len(self.compressor.compress(f"{after}\n{before}{s}".encode())) - least

    def __call__(self, before: str, candidate: str, after: str) -> float:
        """Bytes that the candidate adds over the mean of what random strings of its length and alphabet add."""
        least = len(self.compressor.compress(f"{after}\n{before}".encode()))
        body = candidate.rstrip("=") or candidate
        if re.fullmatch("[0-9A-F]+", body) or re.fullmatch("[0-9a-f]+", body):
            alphabet = "0123456789ABCDEF" if body.upper() == body else "0123456789abcdef"
        else:
            alphabet = "".join(x for x in (string.ascii_lowercase, string.ascii_uppercase, string.digits) if not set(x).isdisjoint(body)) or string.ascii_letters
        rng = random.Random(zlib.crc32(candidate.encode()))
        drawn = [self.added(before, "".join(rng.choices(alphabet, k=len(candidate))), after, least) for _ in range(4)]
        return max(0, self.added(before, candidate, after, least)) / max(1.0, sum(drawn) / len(drawn))


@functools.lru_cache(2)
def _measure(dictionary: bytes | None) -> Novelty:
    return Novelty(dictionary)


NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[A-Z]")


def name_like(candidate: str) -> bool:
    """Whether the parts between separators are words and numbers: words of four letters and more in the mean (or the
    shorter ones that names have, beside a longer one), and few changes between letters and digits inside a part."""
    parts = [NAME_PART.findall(x) for x in re.split("[+/_.=-]+", candidate) if x]
    words = [w for p in parts for w in p if w.isalpha()]
    if not words:
        return len(parts) > 1  # numbers and separators: a date, a version
    changes = sum(a.isdigit() != b.isdigit() for p in parts for a, b in zip(p, p[1:], strict=False))
    mean = sum(map(len, words)) / len(words)
    return changes <= 2 + len(candidate) // 24 and mean >= 3 and (mean >= 4 or len(parts) > 2 and max(map(len, words)) >= 4)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three known kinds, ordered."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def private_runs(text: str) -> list[tuple[int, int]]:
    """The lines of keys between the markers of private keys; a short run counts after a long one only."""
    out = []
    for m in PRIVATE.finditer(text) if "PRIVATE KEY" in text else ():
        heads, at = [h.span() for h in HEADER.finditer(text, *m.span(1))], 0
        began = False
        for run in KEY_RUN.finditer(text, *m.span(1)):
            began = began or len(run[0]) >= 16 and len(set(run[0])) >= 8
            while at < len(heads) and heads[at][1] <= run.start():  # both are in order: one walk along them
                at += 1
            if began and not (at < len(heads) and heads[at][0] <= run.start()):
                out.append(run.span())
    return out


def direct_values(text: str) -> list[tuple[int, int]]:
    """Values that a separator ties to a context."""
    out = []
    for m in VALUE.finditer(text):
        name = NAMED.search(text[max(0, m.start() - NEAR) : m.start()])
        value = m[2]
        if name and re.search("[A-Za-z]", value):
            tied = m[1] or "=" in text[m.start() : m.start(2)] or OUTRIGHT.match(name[0])
            if re.search("[0-9]", value) or tied and value.isalpha() and value.lower() not in PLAIN:
                out.append(m.span(2))
    return out


def novel_spans(text: str, base: list[tuple[int, int, int]], least: float = NOVEL, dictionary: bytes | None = None) -> tuple[list[tuple[int, int, int]], float]:
    """What novelty adds to the base spans, and the highest novelty of any candidate in a sensitive context."""
    added, most, measure = [], 0.0, _measure(dictionary)
    covered = bytearray(len(text))
    for a, _, b in base:
        covered[a:b] = b"\1" * (b - a)

    def add(s: int, e: int) -> None:
        if 1 not in covered[s:e]:
            covered[s:e] = b"\1" * (e - s)
            added.append((s, 3, e))

    def novel(s: int, e: int, named: bool = True) -> bool:
        nonlocal most
        value = measure(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND])
        most = max(most, value)
        return value >= (NAMELIKE / NOVEL * least if named and name_like(text[s:e]) else least)

    for s, e in private_runs(text):
        novel(s, e)
        add(s, e)
    reach = 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if s < reach or not CONTEXT.search(text, max(0, s - NEAR), e) or not novel(s, e):
            continue
        add(s, e)
        while line := ONWARDS.match(text, e):
            run, before = line[1], e - s
            coded = re.search("[0-9+/=]", run) is not None
            if not (len(run) >= 40 or len(run) >= 16 and coded or before >= 40 and coded) or not novel(*line.span(1), named=False):
                break
            s, e = line.span(1)
            add(s, e)
        reach = e
    for s, e in direct_values(text):
        if 1 not in covered[s:e] and novel(s, e, named=False):
            add(s, e)
    return sorted(added), most


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, max_novelty double"


def scan(text: Column, least: float = NOVEL, dictionary: bytes | None = None) -> Column:
    """A struct with counts by kind, the digest of the base spans, all spans, and the novelty figures."""

    @F.pandas_udf(FOUND)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            novel, most = novel_spans(t, base, least, dictionary)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(sorted(base + novel)), len(novel), most))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])

    return scanned(text)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans, number and highest measure of the novel ones."""
    return bounded_batches(docs).select("doc_id", scan(F.col("text"), dictionary=learned(docs)).alias("s")).select("doc_id", "s.*")


def redacted(text: str | None, mark: str = "[SECRET]", least: float = NOVEL, dictionary: bytes | None = None) -> str | None:
    """The text with every span (overlapping ones as one) replaced by the mark."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for s, _, e in sorted(base + novel_spans(text, base, least, dictionary)[0]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Every document stays, with its secrets replaced; n_chars follows the text, a null text stays null."""

    dictionary = learned(docs)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, mark, dictionary=dictionary) for t in texts], dtype=object)

    done = bounded_batches(docs).withColumn("text", clean(F.col("text")))
    changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return done.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
