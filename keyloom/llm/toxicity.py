"""Toxicity by a weighted lexicon that Aho-Corasick matches in folded text.

Folding maps homoglyphs to Latin letters, A-Z to a-z, digits and signs that stand for letters to those letters, and what
parts words to spaces. The lexicon holds whole words and word beginnings (weights: log odds between toxic and clean
training texts), learnt from labelled rows; where several entries start at one word the heaviest counts. Hits inside an
exception phrase don't count. A document's hits, also as a share of its length, go through a logistic function.

Bounds: the lexicon and the function are fitted on at most TRAINING_ROWS labelled ids, taken by the smallest hash, and one
text of each. The lexicon has every entry of those texts that is frequent and toxic enough. Everything is scored.

Defined cases: null, empty and wordless texts have no hits and the score of a text without hits; repeated rows score
alike; a doc_id with several labels is toxic if one says so; null labels teach nothing; without training rows of both
kinds the lexicon is empty and the share of toxic labels (0 without any) is every score; of rows of one doc_id the
smallest text teaches; a very long text is scored whole; only doc_id and text are read, so other columns may have any
names (without_toxic keeps every column).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import as_binary, blocks, map_batches, read_table, stored, text_rows

TRAINING_ROWS = 24_000
#: Bytes of a word's beginning that may become entries.
STEMS = range(5, 9)
MIN_ODDS = 2.5
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h",
    "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y", "Х": "x", "І": "i", "α": "a", "ο": "o", "ν": "v", "ι": "i",
    "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "Α": "a", "Β": "b", "Ε": "e", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m",
    "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Χ": "x", "Ζ": "z",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {b"@": b"a", b"$": b"s"}
# Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "pond scum", "clown fish", "sore loser board")

FULL_WIDTH = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
FOLDED = str.maketrans(HOMOGLYPHS | FULL_WIDTH)
OTHER_SCRIPT = re.compile(rb"[\xce\xcf\xd0\xd1]|\xef[\xbc\xbd]")
SIGN_IN_WORD = re.compile(rb"(?<=[A-Za-z])[@$](?=[A-Za-z])")
TABLE = bytes(
    ord(SUBSTITUTES[chr(c)]) if chr(c) in SUBSTITUTES
    else c + 32 if 65 <= c <= 90
    else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
    else 32
    for c in range(256)
)

N_FEATURES = 7


def fold(text: bytes | None) -> bytes:
    """Folded words parted and enclosed by spaces."""
    if not text:
        return b" "
    if OTHER_SCRIPT.search(text):
        text = text.decode("utf-8", "replace").translate(FOLDED).encode()
    if b"@" in text or b"$" in text:
        text = SIGN_IN_WORD.sub(lambda m: SIGNS[m[0]], text)
    return b" " + text.translate(TABLE) + b" "


def entries_of(word: bytes) -> list[bytes]:
    return [b" " + word + b" ", *(b" " + word[:k] for k in STEMS if len(word) >= k)]


@dataclass
class Model:
    lexicon: dict[bytes, float]
    weights: np.ndarray  # of the standardised features, then the constant
    middle: np.ndarray
    scale: np.ndarray

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.lexicon.items():
            found.add_word(entry.decode("latin-1"), (len(entry), weight))
        for phrase in EXCEPTIONS:
            entry = f" {phrase} "
            found.add_word(entry, (len(entry), None))
        found.make_automaton()
        return found

    @staticmethod
    def features(matcher, text: bytes | None) -> list[float]:
        folded = fold(text)
        heaviest: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        for end, (size, weight) in matcher.iter(folded.decode("latin-1")):
            start = end - size + 1
            if weight is None:
                harmless.append((start, end))
            elif weight > heaviest.get(start, 0.0):
                heaviest[start] = weight
        for a, b in harmless:
            for start in [s for s in heaviest if a <= s < b]:
                del heaviest[start]
        size = len(folded.split())
        total, n, most = sum(heaviest.values()), len(heaviest), max(heaviest.values(), default=0.0)
        return [most, most * most / 5, np.log1p(total), np.log1p(n), np.log1p(100 * total / (size + 30)), np.log1p(100 * n / (size + 30)), np.log1p(size)]

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.middle) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, text, toxic, part of at most rows labelled documents: crc32 of the id decides, part 2 is held out."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labelled = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .withColumn("part", part)
        .where("part <> 2")
        .groupBy("doc_id", "part")
        .agg(F.max("toxic").alias("toxic"))
    )
    # The smallest hashes lie below twice their share, so the one task that takes the first ones sees about 2 * rows ids.
    bound = (2.0 * rows + 64) / max(1, labelled.count())
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + F.lit(0.5)
    chosen = labelled.where(place < F.lit(bound)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "part", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic", "part")


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document counts of each entry; the empty entry counts the documents."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts[1 if toxic else 0]
            own[b""] += 1
            own.update({e for w in set(fold(text).split()) for e in entries_of(w)})
    names = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.binary()), *(pa.array([counts[k][x] for x in names], pa.int64()) for k in (1, 0))],
        names=["entry", "toxic", "clean"],
    )


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Lexicon from parts 0 and 1 of the labelled rows, logistic function from part 3."""
    training = stored(training_rows(docs, labels, rows).withColumn("toxic", (F.col("toxic") > 0).cast("int")))
    counted = (
        map_batches(training.where("part < 2").select("text", "toxic"), _count_entries, "entry binary, toxic long, clean long")
        .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= 3) | (F.col("entry") == F.lit(b"")))
    )
    counted = stored(counted)
    lexicon: dict[bytes, float] = {}
    whole = counted.where(F.col("entry") == F.lit(b"")).first()
    if whole:
        n_toxic, n_clean = whole["toxic"], whole["clean"]
        least = max(3, round(0.006 * n_toxic))
        shift = float(np.log((n_toxic + 1) / (n_clean + 1)))
        weight = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - F.lit(shift)
        good = (F.col("toxic") >= least) & (weight >= MIN_ODDS) & (F.col("entry") != F.lit(b""))
        lexicon = {bytes(r["entry"]): r["weight"] for r in counted.where(good).select("entry", weight.alias("weight")).collect()}
    blank = Model(lexicon, np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES), np.ones(N_FEATURES))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = blank.matcher()
        for batch in batches:
            found = [blank.features(matcher, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "y"]
            )

    fit = map_batches(training.where("part = 3").select("doc_id", "text", "toxic"), measure, "doc_id long, x array<double>, y int")
    got = sorted((r["doc_id"], tuple(r["x"]), r["y"]) for r in fit.collect())
    if not got or len({y for *_, y in got}) < 2:
        share = float(np.clip(np.mean([y for *_, y in got]), 1e-6, 1 - 1e-6)) if got else 1e-9
        return Model(lexicon, np.append(np.zeros(N_FEATURES), np.log(share / (1 - share))), blank.middle, blank.scale)
    x, y = np.array([v for _, v, _ in got]), np.array([v for *_, v in got], float)
    middle, scale = x.mean(0), x.std(0) + 1e-9
    return Model(lexicon, logistic(np.c_[(x - middle) / scale, np.ones(len(x))], y), middle, scale)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the last column is the constant and has no penalty."""
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for keys, texts in blocks(batches):
            found = model.scores(np.array([model.features(matcher, t) for t in texts]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found)], names=["doc_id", "score"])

    return map_batches(text_rows(docs), run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, that score under the threshold."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                found = model.scores(np.array([model.features(matcher, t) for t in texts]))
                yield batch.filter(pa.array(found < threshold))

    return map_batches(docs, run, docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = score_documents(docs, learn(docs, read_table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
