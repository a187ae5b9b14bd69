"""Language identification by prediction by partial matching over bytes.

Each language has a tree of the byte contexts of zero to three bytes seen in its training texts. The probability of a
byte is taken in the longest seen context; a byte unseen there escapes (method C: distinct bytes against occurrences) to
the next shorter one, and at last to an even share of the alphabet. Statistics are frozen, so the exact code length of
every (context, byte) is computed once and a text's code length is a sum of table entries. The shortest code wins.

Letters are lower-cased in ASCII, other ASCII characters are spaces, bytes of other characters stay as they are.

Bounds: the trees are fitted on at most ROWS_PER_LANGUAGE labelled documents of each of the LANGUAGES most frequent
languages, taken by the smallest hash of their id, one whole text each. They keep every context of those texts. All texts
are scored whole.

Defined cases: a null text and one without a letter give `und` and score 0, as does everything if no language was
learnt; ties go to the alphabetically first language; repeated rows score alike; of rows of one doc_id and language the
smallest text teaches; a very long text is scored in a block of its own; an empty table gives no rows; only
doc_id, text and, for training rows, lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import as_binary, blocks, map_batches, read_table, text_rows

ROWS_PER_LANGUAGE, LANGUAGES = 800, 1024
ORDER = 3
#: Symbols: a space, 26 letters, 128 other bytes.
SIZE = 155
SYMBOL = bytes(
    c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else c - 128 + 27 if c >= 128 else 0 for c in range(256)
)
LETTER = re.compile(rb"[A-Za-z]")
PAD = b"\0" * ORDER


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace")))


def symbols(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols, each text after a pad of ORDER spaces; where each text begins and ends."""
    flat = np.frombuffer(b"".join([PAD + (t or b"").translate(SYMBOL) for t in texts]), np.uint8).astype(np.int32)
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    begins = np.cumsum(sizes + ORDER) - sizes
    return flat, begins, begins + sizes


def contexts(flat: np.ndarray) -> np.ndarray:
    """Number of the three symbols before each one; the first three have none."""
    code = np.zeros(len(flat), np.int32)
    code[ORDER:] = (flat[:-3] * SIZE + flat[1:-2]) * SIZE + flat[2:-1]
    return code


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of four-symbol runs by language."""
    by_language: dict[str, list] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_language.setdefault(lang, []).append(text)
    for lang, texts in by_language.items():
        flat, begins, ends = symbols(texts)
        inside = np.zeros(len(flat) + 1, np.int64)
        np.add.at(inside, begins, 1)
        np.add.at(inside, ends, -1)
        keep = np.cumsum(inside[:-1]) > 0
        run, n = np.unique((contexts(flat).astype(np.int64) * SIZE + flat)[keep], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(run), pa.string()), pa.array(run), pa.array(n)], names=["lang", "run", "n"])


class Found:
    """Numbers of known keys: an open table, so that a lookup takes the same time however many there are."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = (1 << max(4, int(4 * len(keys)).bit_length())) - 1
        self.table = np.full(self.mask + 1, -1, np.int32)
        place, left = self._first(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.table[place[left]] < 0
            self.table[place[left[free]]] = left[free]
            left = left[self.table[place[left]] != left]
            place[left] = (place[left] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(32)).astype(np.int64) & self.mask

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        place = self._first(keys)
        out = self.table[place]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys)) if len(self.keys) else []
        while len(left):
            place[left] = (place[left] + 1) & self.mask
            out[left] = self.table[place[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != keys[left])]
        return out


class Trees:
    """Frozen code lengths of every symbol after every context seen: runs of three symbols and one more by number, shorter
    contexts as tables, escapes of three symbols by context."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.counts = counts
        self._tables: tuple | None = None

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "counts": self.counts, "_tables": None}

    @property
    def tables(self) -> tuple[Found, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Numbers of the runs; rows of the shorter contexts; escape of each three symbols; by language, code lengths of runs
        and then of the shorter contexts' symbols, and escapes (the first is none)."""
        if self._tables is None:
            runs = np.unique(np.concatenate([r for r, _ in self.counts.values()])) if self.counts else np.zeros(0, np.int64)
            three, two = np.unique(runs // SIZE), np.unique(runs // SIZE % SIZE**2)
            rows = np.tile(np.arange(SIZE, dtype=np.int32), SIZE)  # one symbol of context
            rows[two] = SIZE + np.arange(len(two), dtype=np.int32)
            escape = np.zeros(SIZE**3, np.int32)
            escape[three] = 1 + np.arange(len(three), dtype=np.int32)
            both = [self._lengths(*self.counts[x], runs, three, two, rows, escape) for x in self.languages]
            self._tables = Found(runs), rows, escape, [x for x, _ in both], [x for _, x in both]
        return self._tables

    @staticmethod
    def _lengths(run: np.ndarray, n: np.ndarray, runs: np.ndarray, three: np.ndarray, two: np.ndarray, rows: np.ndarray, escape: np.ndarray) -> tuple:
        """A language's code lengths and escapes, as tables has them."""

        def level(keys: np.ndarray, wanted: np.ndarray, below: np.ndarray) -> np.ndarray:
            """keys: context * SIZE + symbol of each run; below: code lengths after an escape, by wanted context."""
            at, count = _sum(keys, n)
            seen = np.zeros((len(wanted), SIZE))
            seen[np.searchsorted(wanted, at // SIZE), at % SIZE] = count
            total, distinct = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                escaped = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
                return np.where(seen > 0, -np.log2(seen / (total + distinct)), escaped + below)

        zero = level(run % SIZE, np.zeros(1, np.int64), np.full((1, SIZE), np.log2(SIZE)))
        one = level(run % SIZE**2, np.arange(SIZE), np.repeat(zero, SIZE, 0))
        shorter = np.concatenate([one, level(run % SIZE**3, two, one[two % SIZE])])
        at, count = _sum(run, n)
        context, first = np.unique(at // SIZE, return_index=True)
        total, distinct = np.add.reduceat(count, first) if len(at) else count, np.diff(np.append(first, len(at)))
        escapes = np.zeros(len(three) + 1)
        escapes[escape[context]] = -np.log2(distinct / (total + distinct))
        lengths = shorter[rows[runs // SIZE % SIZE**2], runs % SIZE] + escapes[escape[runs // SIZE]]
        own = np.searchsorted(context, at // SIZE)
        lengths[np.searchsorted(runs, at)] = -np.log2(count / (total + distinct)[own])
        return np.concatenate([lengths, shorter.ravel()]).astype(np.float32), escapes.astype(np.float32)

    def code_lengths(self, texts: list[bytes | None]) -> np.ndarray:
        """Bits of each text in each language."""
        found, rows, escape, lengths, escapes = self.tables
        flat, begins, ends = symbols(texts)
        context = contexts(flat)
        number = found.of(context.astype(np.int64) * SIZE + flat)
        known = number >= 0
        at = np.where(known, number, len(found.keys) + rows[context % SIZE**2] * SIZE + flat)
        out_of = np.where(known, 0, escape[context])
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(ends > begins)
        cuts = np.stack([begins[some], ends[some]], 1).ravel()
        for k in range(len(self.languages)):
            bits = np.append(lengths[k][at] + escapes[k][out_of], np.float32(0))
            out[some, k] = np.add.reduceat(bits, cuts, dtype=np.float64)[::2] if len(some) else 0
        return out


def _sum(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, inverse = np.unique(keys, return_inverse=True)
    return at, np.bincount(inverse, n, len(at)).astype(np.int64)


def learn(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Trees:
    """Trees from rows whose crc32 of the id, mod 3, isn't 1."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), as_binary("text"))
    training = known.select("doc_id", "lang").where(
        "lang is not null and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"
    )
    training = training.distinct()
    # The smallest hashes of a language lie below twice their share, so the ranking sees about 2 * rows of it, not all.
    sizes = training.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + F.lit(0.5)
    near = training.join(F.broadcast(sizes), "lang").where(place < (F.lit(2.0 * rows) + F.lit(64.0)) / F.col("n"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows).select("doc_id", "lang")
    # LANGUAGES * rows pairs of an id and a language at most
    texts = known.where("text is not null").join(F.broadcast(chosen), ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    got = map_batches(texts, _count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).orderBy("lang", "run").toArrow()
    lang, run, n = np.array(got.column("lang").to_pylist()), got.column("run").to_numpy(), got.column("n").to_numpy()
    return Trees({x: (run[lang == x], n[lang == x]) for x in sorted(set(lang.tolist()))})


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred, score: the share of the winner if each language is as likely before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in blocks(batches):
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if trees.languages:
                bits = trees.code_lengths(texts)
                best = bits.argmin(1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                for i, t in enumerate(texts):
                    if has_letter(t):
                        names[i], scores[i] = trees.languages[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return map_batches(text_rows(docs), run, "doc_id long, lang_pred string, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "lang_pred", "score"
    )
