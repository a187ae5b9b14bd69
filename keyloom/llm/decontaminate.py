"""Benchmark decontamination with a positional inverted index that is partitioned by documents.

Documents are cut to segments. Each segment stores, for every term of its documents, the ascending word positions of that
term (its postings). The index knows nothing of any benchmark, so a new one is asked of the same stored index. A query is
answered in each segment alone: the rarest term of a phrase there gives the candidate starts, and the lists of the other
terms, moved by their offsets, are intersected with them from the next rarest on. Only lists of asked terms are unpacked.

Defined cases: a null or wordless text has no words and no hits; an item without words never occurs; an item shorter
than the window is one window of its own length; a very long text is a segment of its own; rows that repeat a doc_id are
separate documents; equal windows of several items hit all of them; an empty documents table gives no rows; an empty
benchmark table leaves every document clean. Only doc_id, text and item_id, text are read, so other columns may have any
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import blocks, map_batches, read_table, stored, text_rows, words_of

WINDOW = 8
#: Bytes of text in a segment.
SEGMENT_BYTES = 4 << 20
#: Words of the test items that one pass over the index asks for, as their windows go to every executor. A larger test set
#: is asked in several passes over the same stored index, one after the other.
PASS_WORDS = 2_000_000
#: Words that op8_proximity allows between those of a window.
SLOP = 2
#: Places that a proximity search looks at together.
CHUNK = 1 << 17

SEGMENT_SCHEMA = (
    "segment string, doc_ids array<long>, text_md5 array<binary>, starts array<long>, n_words array<long>, terms array<binary>, "
    "counts array<int>, postings binary"
)
DOC_SCHEMA = (
    "segment string, place int, doc_id long, text_md5 binary, n_words long, n_hit long, items array<string>, "
    "hits array<struct<start: long, end: long>>"
)


def build_index(docs: DataFrame) -> DataFrame:
    """One row per segment: its documents and the postings of all their terms, in the terms' order. A position between two
    documents belongs to no term, so no phrase can cross it."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        for number, (keys, texts) in enumerate(blocks(batches, SEGMENT_BYTES)):
            known: dict[bytes, int] = {}
            lengths, ids = [], []
            for text in texts:
                words = words_of(text)
                lengths.append(len(words))
                ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            sizes = np.array(lengths, np.int64)
            starts = np.cumsum(sizes + 1) - sizes - 1
            flat = np.concatenate(ids)
            places = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(flat, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task.partitionId() if task else 0}-{number}"]),
                    pa.array([keys], pa.list_(pa.int64())),
                    pa.array([[hashlib.md5(t or b"").digest() for t in texts]], pa.list_(pa.binary())),
                    pa.array([starts], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([list(known)], pa.list_(pa.binary())),
                    pa.array([np.bincount(flat, minlength=len(known))], pa.list_(pa.int32())),
                    pa.array([places[order].astype(np.int32 if len(flat) + len(sizes) < 2**31 else np.int64).tobytes()], pa.binary()),
                ],
                names=["segment", "doc_ids", "text_md5", "starts", "n_words", "terms", "counts", "postings"],
            )

    return map_batches(text_rows(docs), segments, SEGMENT_SCHEMA)


class Question:
    """Phrases to ask a segment for: word numbers of all of them, one after the other, and where each begins."""

    def __init__(self, phrases: list[tuple[bytes, ...]]):
        self.asked: dict[bytes, int] = {}
        number = lambda w: self.asked.setdefault(w, len(self.asked))
        self.flat = np.array([number(w) for p in phrases for w in p], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum([len(p) for p in phrases])]).astype(np.int64)
        self.longest = max(map(len, phrases), default=0)


class Segment:
    """A stored segment, ready for queries of the asked terms (term -> number in the question)."""

    def __init__(self, row: dict, asked: dict[bytes, int], longest: int):
        counts = np.array(row["counts"], np.int64)
        total, size = int(counts.sum()), len(row["postings"])
        positions = np.frombuffer(row["postings"], np.int32 if size == 4 * total else np.int64)
        number = np.fromiter((asked.get(t, -1) for t in row["terms"]), np.int64, len(row["terms"]))
        own = np.flatnonzero(number >= 0)
        #: The segment's number of each asked term; -1 if it isn't there.
        self.local = np.full(len(asked), -1, np.int64)
        self.local[number[own]] = np.arange(len(own))
        ends = np.cumsum(counts)
        self.counts = counts[own]
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])
        shift = np.repeat((ends - counts)[own] - self.begins[:-1], self.counts)
        self.positions = positions[np.arange(int(self.begins[-1])) + shift].astype(np.int64)
        self.doc_ids, self.starts = row["doc_ids"], np.array(row["starts"], np.int64)
        self.n_words = np.array(row["n_words"], np.int64)
        #: Sorted (term, position) pairs as one number: an exact membership test for all lists at once.
        self.span = int((self.starts + self.n_words).max(initial=0)) + longest + 1
        self.keyed = np.repeat(np.arange(len(own)), self.counts) * self.span + self.positions

    def present(self, question: Question) -> tuple[np.ndarray, list[np.ndarray]]:
        """The phrases whose terms are all here, and their terms by this segment's numbers."""
        if not len(question.flat):
            return np.zeros(0, np.int64), []
        terms = self.local[question.flat]
        there = np.flatnonzero(np.logical_and.reduceat(terms >= 0, question.cuts[:-1]))
        return there, [terms[a:b] for a, b in zip(question.cuts[there].tolist(), question.cuts[there + 1].tolist(), strict=True)]

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.span + position
        at = np.searchsorted(self.keyed, key)
        return (position >= 0) & (at < len(self.keyed)) & (self.keyed[np.minimum(at, len(self.keyed) - 1)] == key)

    def phrases(self, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(query number, start position) of every place where a query's terms stand consecutively.

        queries: term numbers of this segment per query, grouped by length here; none may be missing from the segment.
        """
        numbers, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        by_length: dict[int, list[int]] = {}
        for i, q in enumerate(queries):
            by_length.setdefault(len(q), []).append(i)
        for length, own in by_length.items():
            matrix = np.stack([queries[i] for i in own])
            rank = np.argsort(self.counts[matrix], axis=1, kind="stable")  # offsets, rarest term first
            first = rank[:, 0]
            anchor = matrix[np.arange(len(own)), first]
            n = self.counts[anchor]
            query = np.repeat(np.arange(len(own)), n)
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[np.repeat(self.begins[anchor], n) + inside] - np.repeat(first, n)
            for k in range(1, length):
                offset = rank[query, k]
                good = self.holds(matrix[query, offset], start + offset)
                query, start = query[good], start[good]
            numbers.append(np.array(own, np.int64)[query])
            places.append(start)
        return np.concatenate(numbers), np.concatenate(places)

    def near(self, queries: list[np.ndarray], widths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, start, exclusive end) of the smallest span before each end that holds all terms of a query, in
        any order, in one document and at most the query's width long.

        queries: distinct term numbers of this segment per query; none may be missing from the segment.
        """
        parts = [np.zeros((3, 0), np.int64)]
        by_length: dict[int, list[int]] = {}
        for i, q in enumerate(queries):
            by_length.setdefault(len(q), []).append(i)
        for length, own in by_length.items():
            terms = np.stack([queries[i] for i in own])
            terms = np.take_along_axis(terms, np.argsort(self.counts[terms], axis=1, kind="stable"), 1)  # rarest first
            width = np.array([widths[i] for i in own], np.int64)
            n = self.counts[terms[:, 0]]
            upto = np.cumsum(n)
            for low in range(0, int(upto[-1]), CHUNK):
                flat = np.arange(low, min(low + CHUNK, int(upto[-1])))
                query = np.searchsorted(upto, flat, "right")
                anchor = self.positions[self.begins[terms[query, 0]] + flat - (upto - n)[query]]
                doc = self.doc_of(anchor)
                left = np.maximum(anchor - width[query] + 1, self.starts[doc])
                right = np.minimum(np.minimum(anchor + width[query], (self.starts + self.n_words)[doc]), self.span) - 1
                for k in range(1, length):
                    key = terms[query, k] * self.span
                    at = np.searchsorted(self.keyed, key + left)
                    good = (at < len(self.keyed)) & (self.keyed[np.minimum(at, len(self.keyed) - 1)] <= key + right)
                    query, anchor, left, right = query[good], anchor[good], left[good], right[good]
                step = max(1, 16 * CHUNK // int(width.max()))
                for a in range(0, len(query), step):
                    found = self._spans(terms, width, query[a : a + step], anchor[a : a + step], right[a : a + step])
                    parts.append(np.stack([np.array(own, np.int64)[found[0]], *found[1:]]))
        number, start, end = np.concatenate(parts, axis=1)
        only = np.unique(number * (self.span + 1) + end, return_index=True)[1]  # an end has one start
        return number[only], start[only], end[only]

    def _spans(self, terms: np.ndarray, width: np.ndarray, query: np.ndarray, anchor: np.ndarray, right: np.ndarray) -> tuple:
        """near's spans that end from anchor to right."""
        pairs = []
        for k in range(terms.shape[1]):
            key = terms[query, k] * self.span
            begin, stop = np.searchsorted(self.keyed, key + anchor), np.searchsorted(self.keyed, key + right, "right")
            n = stop - begin
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.repeat(query, n) * self.span + self.positions[np.repeat(begin, n) + inside])
        query, end = np.divmod(np.unique(np.concatenate(pairs)), self.span)
        start = end
        for k in range(terms.shape[1]):
            term = terms[query, k]
            at = np.searchsorted(self.keyed, term * self.span + end, "right") - 1
            start = np.minimum(start, np.where(at >= self.begins[term], self.positions[at], -1))
        good = (start >= self.starts[self.doc_of(end)]) & (end - start < width[query])
        return query[good], start[good], end[good] + 1

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def per_document(row: dict, segment: Segment, whose: list[list[str]], start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """The documents of a segment by DOC_SCHEMA, from matches: the items of each, its start and its exclusive end."""
    doc = segment.doc_of(start)
    hit = [set() for _ in segment.doc_ids]
    for d, items in zip(doc.tolist(), whose, strict=True):
        hit[d].update(items)
    order = np.argsort(start, kind="stable")
    start, end, doc = start[order], end[order], doc[order]
    # occurrences that touch become one stretch; none reaches into another document
    reach = np.maximum.accumulate(end) if len(end) else end
    fresh = np.flatnonzero(np.append(True, start[1:] > reach[:-1])) if len(end) else end
    first, last, of = start[fresh], np.append(reach[fresh[1:] - 1], reach[-1:]), doc[fresh]
    stretches: list[list[dict]] = [[] for _ in segment.doc_ids]
    for d, x, y in zip(of.tolist(), (first - segment.starts[of]).tolist(), (last - segment.starts[of]).tolist(), strict=True):
        stretches[d].append({"start": x, "end": y})
    n = len(segment.doc_ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["segment"]] * n, pa.string()),
            pa.array(range(n), pa.int32()),
            pa.array(segment.doc_ids, pa.int64()),
            pa.array(row["text_md5"], pa.binary()),
            pa.array(segment.n_words),
            pa.array(np.bincount(of, last - first, n).astype(np.int64)),
            pa.array([sorted(x) for x in hit], pa.list_(pa.string())),
            pa.array(stretches, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ],
        names=["segment", "place", "doc_id", "text_md5", "n_words", "n_hit", "items", "hits"],
    )


def exact_matches(index: DataFrame, items: list[tuple[object, list[bytes]]], size: int = WINDOW) -> DataFrame:
    """Per document of the index: its words, the words inside any occurrence of a window of an item, and those items."""
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for item, words in items:
        for window in windows_of(words, size):
            owners.setdefault(window, set()).add(str(item))
    whose = [sorted(x) for x in owners.values()]
    question = Question(list(owners))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, question.asked, question.longest)
                asked, queries = segment.present(question)
                number, start = segment.phrases(queries)
                sizes = np.array([len(q) for q in queries], np.int64)[number] if len(number) else number
                yield per_document(row, segment, [whose[asked[i]] for i in number.tolist()], start, start + sizes)

    return map_batches(index, answer, DOC_SCHEMA)


def _near(index: DataFrame, phrases: list[tuple[str, list[bytes]]], slop: int, with_spans: bool = False) -> DataFrame:
    """per_document of the phrases (item, words) whose distinct words stand near each other; if asked, also their spans."""
    owners: dict[tuple[tuple[bytes, ...], int], set[str]] = {}
    for item, words in phrases:
        if words:
            owners.setdefault((tuple(sorted(set(words))), len(words) + slop), set()).add(item)
    widths = [w for _, w in owners]
    whose = [sorted(x) for x in owners.values()]
    question = Question([words for words, _ in owners])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, question.asked, question.longest)
                asked, queries = segment.present(question)
                number, start, end = segment.near(queries, [widths[i] for i in asked])
                names = [whose[asked[i]] for i in number.tolist()]
                out = per_document(row, segment, names, start, end)
                if not with_spans:
                    yield out
                    continue
                spans: list[set] = [set() for _ in segment.doc_ids]
                doc = segment.doc_of(start)
                base = segment.starts[doc]
                for d, items, x, y in zip(doc.tolist(), names, (start - base).tolist(), (end - base).tolist(), strict=True):
                    spans[d].update((i, x, y) for i in items)
                kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                rows = [[dict(zip(("item_id", "start", "end"), x, strict=True)) for x in sorted(own)] for own in spans]
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rows, kind)], names=[*out.schema.names, "spans"])

    more = ", spans array<struct<item_id: string, start: long, end: long>>" if with_spans else ""
    return map_batches(index, answer, DOC_SCHEMA + more)


def proximity_matches(index: DataFrame, items: list[tuple[object, list[bytes]]], slop: int) -> DataFrame:
    """(doc_id, item_id, start, end): smallest spans that hold all distinct words of an item, in any order, with at most
    slop words more than the item has. One row per end of such a span; words count from 0, end is exclusive."""
    found = _near(index, [(str(item), words) for item, words in items], slop, with_spans=True)
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.item_id", "s.start", "s.end")


def near_documents(docs: DataFrame, benchmark: DataFrame, slop: int, size: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """As decontaminate, by proximity: an item is in a document if all distinct words of a window of it, or of the whole
    item, stand there in any order in at most slop words more. Every exact occurrence is one."""

    def phrases(items: list[tuple[object, list[bytes]]]) -> list[tuple[str, list[bytes]]]:
        return [(str(i), list(p)) for i, words in items for p in [*windows_of(words, size), words]]

    index = stored(build_index(docs))
    found = in_passes(benchmark, pass_words, lambda items: _near(index, phrases(items), slop))
    return found.select("doc_id", "text_md5", "n_words", "n_hit", "items", "hits")


def in_passes(benchmark: DataFrame, limit: int, ask: Callable[[list], DataFrame]) -> DataFrame:
    """The answers to all items. Several passes are run one by one, so the driver holds the items of one."""
    passes = test_items(benchmark, limit)
    first, second = next(passes, []), next(passes, None)
    if second is None:
        return ask(first)
    parts = [stored(ask(first)), stored(ask(second))]
    del first, second
    return united([*parts, *(stored(ask(items)) for items in passes)])


def united(parts: list[DataFrame]) -> DataFrame:
    """The answers of several passes as one row per document: items and hit stretches together."""
    if len(parts) == 1:
        return parts[0]
    flat = lambda c: F.flatten(F.collect_list(c))
    both = reduce(DataFrame.union, parts).groupBy("segment", "place").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "text_md5", "n_words")),
        F.array_sort(F.array_distinct(flat("items"))).alias("items"),
        F.array_sort(flat("hits")).alias("hits"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))

    def step(acc: Column, hit: Column) -> Column:
        more = F.greatest(hit["end"] - F.greatest(hit["start"], acc["reach"]), F.lit(0))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["reach"], hit["end"]).alias("reach"))

    return both.withColumn("n_hit", F.aggregate("hits", start, step, lambda acc: acc["n"])).select(*parts[0].columns)


def test_items(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their words, in passes of about limit words."""
    items: list = []
    size = 0
    for row in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        words = words_of(bytes(row["text"]) if row["text"] is not None else None)
        if items and size + len(words) > limit:
            yield items
            items, size = [], 0
        items.append((row["item_id"], words))
        size += len(words)
    if items:
        yield items


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """doc_id, text_md5, n_words, n_hit, items: the item ids with a window in the document, sorted as strings."""
    index = stored(build_index(docs))
    found = in_passes(benchmark, pass_words, lambda items: exact_matches(index, items, size))
    return found.select("doc_id", "text_md5", "n_words", "n_hit", "items", "hits")


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, size: int = WINDOW) -> DataFrame:
    """The documents, all columns as they are and whatever their names, in which windows of fewer than min_items items
    occur. Rows are told apart by doc_id and text, so a clean row of the same doc_id stays."""
    found = decontaminate(docs, benchmark, size).where(F.size("items") >= min_items)
    leaks = stored(found.select(F.col("doc_id").alias("id"), F.col("text_md5").alias("md5")).distinct())
    marked = docs.select(
        F.struct(*(F.col(c) for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("own_id"),
        F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))).alias("own_md5"),
    )
    kept = marked.join(leaks, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_md5") == F.col("md5")), "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        n.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n >= 2).alias("contaminated"),
    )


def op8_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's SQL fixes its columns, so the proximity matches are a query of their own."""
    found = near_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), SLOP)
    return found.select(
        "doc_id",
        "n_words",
        F.col("n_hit").alias("n_near"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.col("hits").alias("stretches"),
    )


OP8_SQL = """
WITH words AS (
  SELECT 'd' AS kind, row_number() OVER () AS row_id, doc_id AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS size, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8 + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT row_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)
), found AS (
  SELECT DISTINCT d.row_id, d.i, d.size, t.item_id FROM doc_windows d JOIN item_windows t USING (size, gram)
), hit AS (
  SELECT row_id, count(DISTINCT p)::BIGINT AS n_hit
  FROM (SELECT row_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY row_id
), per_doc AS (
  SELECT row_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM found) GROUP BY row_id
)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM words LEFT JOIN hit USING (row_id) LEFT JOIN per_doc USING (row_id)
"""
