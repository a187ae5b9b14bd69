"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

1. A shingle in df of N documents weighs its occurrences times 1 + log(N / max(df, N / RARE)) / log(RARE), between once
   and twice its occurrences. Frequencies are exact: a count sketch of all shingles of all documents shows which cells can
   hold one that is in a document of RARE or more, and the shingles of those cells are counted one by one. At most
   RARE times the shingles of a mean document are that frequent, whatever the corpus.
2. Equal texts become one node, by md5. Each text gets BANDS x ROWS consistent weighted samples; a band's samples make
   its bucket, in each of the GROUPINGS of samples to bands.
3. Nodes of a bucket are linked to its smallest node; connected components of these links are candidate groups.
4. Every pair inside a candidate group is compared by exact weighted Jaccard similarity through the group's own inverted
   lists. A group with more than TILE nodes or TILE_BYTES of text is cut to tiles and each pair of tiles is a task of its
   own, so no task holds an unbounded group and no pair of a group is left out. A task returns a spanning forest of its
   links, never all pairs.
5. Components of the links are the classes; the class id is the smallest doc_id.

Keys with over a part in HOT of the rows (a text that a third of all documents share, the middle of a star) are joined by
sending their HOT rows at most to every task; only the others are shuffled.

Defined cases: null and empty texts are alone, each row a class of its own doc_id; equal wordless texts are one class; a
text of one to four words has one shingle of all its words; a very long text is one node like any other, and a task of its
own where it exceeds TILE_BYTES; equal rows are in one class; rows of one doc_id but other texts are nodes of their own,
though their classes may be named alike; an empty table gives no rows; only doc_id and text are read (without_duplicates
keeps every column, whatever its name).
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import WORD_TABLE, blocks, delete_stored, map_batches, read_table, stored, text_rows

SHINGLE = 5
THRESHOLD = 0.8
#: Each sample is in GROUPINGS bands, with other samples each time: a pair that one grouping misses the other finds, at no
#: more samples. A pair at the threshold is missed by one grouping in about 0.18 % of cases; by both, as they regroup the
#: same samples, in about 0.013 % (simulated).
BANDS, ROWS, GROUPINGS = 12, 4, 2
SKETCH_SIZE = 1 << 20
#: Shingles in fewer than a document of RARE weigh alike.
RARE = 1000
HOT = 1000
TILE, TILE_BYTES = 2048, 24 << 20
#: Bytes of text in a block of vectorised work; its arrays stay in a core's cache.
BLOCK = 1 << 18

U = np.uint64
MIX = (U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers."""
    x = x + MIX[0]
    x = (x ^ (x >> U(30))) * MIX[1]
    x = (x ^ (x >> U(27))) * MIX[2]
    return x ^ (x >> U(31))


BYTE = mixed(np.arange(256, dtype=np.uint64))
BYTE[32] = 0
POWER = np.cumprod(np.full(64, 0x9FB21C651E98DF25, np.uint64))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text): a polynomial over a word's bytes, mixed."""
    global POWER
    parts = [(t or b"").translate(WORD_TABLE) for t in texts]
    blob = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    inside = blob != 32
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    texts_end = np.cumsum([len(p) + 1 for p in parts])
    sizes = np.diff(np.searchsorted(starts, texts_end), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), sizes
    span = np.diff(np.append(starts, len(blob)))
    if span.max() > len(POWER):
        POWER = np.cumprod(np.full(2 * int(span.max()), POWER[0], np.uint64))
    place = np.arange(starts[0], len(blob)) - np.repeat(starts, span)
    return mixed(np.add.reduceat(BYTE[blob[starts[0] :]] * POWER[place], starts - starts[0])), sizes


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, occurrences, bounds): the distinct shingles of each text; text i has bounds[i]:bounds[i + 1]."""
    flat, sizes = word_hashes(texts)
    begins = np.cumsum(sizes) - sizes
    per = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(texts)), per)
    start = np.repeat(begins, per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    left = np.repeat(np.minimum(sizes, SHINGLE), per)
    h = np.zeros(len(start), np.uint64)
    padded = np.append(flat, np.zeros(SHINGLE, np.uint64))
    whole = len(left) == 0 or int(left.min()) == SHINGLE
    for k in range(SHINGLE):
        word = padded[start + k]
        h = mixed(h ^ (word if whole else np.where(k < left, word, U(0))))
    order = _by_text(owner, h)
    h, owner = h[order], owner[order]
    fresh = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(fresh, len(h)))
    h, owner = h[fresh], owner[fresh]
    return h, count, np.searchsorted(owner, np.arange(len(texts) + 1))


def _by_text(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """An order in which each text's equal hashes stand together. One sort of a combined key does it, unless two hashes of
    a text agree in the key's part but not in the rest: then both keys are sorted."""
    if len(owner) and int(owner[-1]) < 1 << 20:
        order = np.argsort((owner.astype(np.uint64) << U(44)) | (h >> U(20)))
        a, b = h[order[:-1]], h[order[1:]]
        if not ((a != b) & (a >> U(20) == b >> U(20)) & (owner[order[:-1]] == owner[order[1:]])).any():
            return order
    return np.lexsort((h, owner))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: key is the md5 of the text, or null for a null or empty text."""
    text = F.col("text").cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.length(text) > 0, F.unhex(F.md5(text))).alias("key"),
        text.alias("text"),
    )


class Weights:
    """Weight of an occurrence of a shingle by its hash: frequent ones are listed, all others weigh the most."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n_docs: int, rare: int = RARE):
        order = np.argsort(hashes)
        self.hashes, n = hashes[order], max(1, n_docs, rare)
        share = np.maximum(np.maximum(df[order], 1) / n, 1 / rare)
        self.weights = np.append(1 - np.log(share) / np.log(rare), 1 - np.log(max(1 / n, 1 / rare)) / np.log(rare))
        self.cells = np.zeros(SKETCH_SIZE, bool)
        self.cells[(self.hashes % U(SKETCH_SIZE)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.weights[-1])
        some = np.flatnonzero(self.cells[(h % U(SKETCH_SIZE)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            out[some] = self.weights[np.where(self.hashes[at] == h[some], at, -1)]
        return out


def learn_weights(docs: DataFrame, rare: int = RARE, size: int = SKETCH_SIZE) -> Weights:
    """Weights by the exact document frequencies of the frequent shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for _, texts in blocks(batches, BLOCK):
            h, _, _ = shingles(texts)
            total += np.bincount((h % U(size)).astype(np.int64), minlength=size)
            n += len(texts)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["place", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n])], names=["place", "n"])

    rows = docs.select(F.lit(0).alias("k"), F.col("text").cast("binary").alias("text"))
    got = map_batches(rows, count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = got.column("place").to_numpy(), got.column("n").to_numpy()
    n_docs = int(n[place < 0].sum())
    cells = np.zeros(size, np.int64)
    cells[place[place >= 0]] = n[place >= 0]
    # A frequent shingle's cell holds its documents beside the load of all others. No cell's load is below the least one
    # (for a given shingle with a chance of 1 in size, as the cells are exchangeable).
    least = max(2, -(-n_docs // rare))
    wanted = cells >= least + int(cells.min())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        held, n_held = [], 0
        for _, texts in blocks(batches, BLOCK):
            h, _, _ = shingles(texts)
            held.append(h[wanted[(h % U(size)).astype(np.int64)]])
            n_held += len(held[-1])
            if n_held > 1 << 20:
                yield batch(*np.unique(np.concatenate(held), return_counts=True))
                held, n_held = [], 0
        if n_held:
            yield batch(*np.unique(np.concatenate(held), return_counts=True))

    counted = map_batches(rows, pick, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    return Weights(counted.column("h").to_numpy().astype(np.int64).view(np.uint64), counted.column("n").to_numpy(), n_docs, rare)


def samples(h: np.ndarray, weight: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Improved consistent weighted sampling: n samples for each non-empty set, as hashes of (shingle, level)."""
    begins = bounds[:-1]
    log_w = np.log(weight).astype(np.float32)
    index = np.arange(len(h), dtype=np.int64)
    tiny, scale = np.float32(2.0**-33), np.float32(2.0**-32)
    out = np.empty((len(begins), n), np.uint64)

    def gamma(bits: np.ndarray) -> np.ndarray:
        """Gamma(2, 1) from 64 random bits, which it uses up."""
        pair = bits.view(np.uint32).reshape(-1, 2)
        u, v = pair[:, 0].astype(np.float32), pair[:, 1].astype(np.float32)
        u *= scale
        u += tiny
        v *= scale
        v += tiny
        u *= v
        return np.negative(np.log(u, out=u), out=u)

    for k in range(n):
        x = mixed(h + U((k + 1) * int(MIX[1]) % 2**64))
        y = x * MIX[0]
        y ^= y >> U(29)
        y *= MIX[2]
        y ^= y >> U(32)
        r, c = gamma(x), gamma(y)
        y *= MIX[1]
        beta = (y >> U(40)).astype(np.float32)
        beta *= np.float32(2.0**-24)
        level = log_w / r
        level += beta
        np.floor(level, out=level)
        beta -= level
        beta -= np.float32(1)
        beta *= r
        log_a = np.log(c, out=c)
        log_a += beta  # log c - r (level - beta + 1)
        bits = log_a.view(np.int32)
        ordered = np.where(bits < 0, bits ^ np.int32(0x7FFFFFFF), bits).astype(np.int64)  # as floats order
        ordered <<= 31
        ordered += index
        least = np.minimum.reduceat(ordered, begins) & ((1 << 31) - 1)
        out[:, k] = mixed(h[least] ^ mixed(level[least].astype(np.int64).view(np.uint64)))
    return out


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, key, bands: a hash for each band, or null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, BLOCK):
            h, count, bounds = shingles(texts)
            some = np.flatnonzero(np.diff(bounds))
            bands: list = [None] * len(texts)
            if len(some):
                weight = (count * weights.of(h)).astype(np.float32)
                drawn = samples(h, weight, np.append(bounds[some], bounds[-1]), BANDS * ROWS)
                across = drawn.reshape(len(some), ROWS, BANDS).transpose(0, 2, 1)
                drawn = np.concatenate([drawn.reshape(len(some), BANDS, ROWS), across], 1)
                bucket = np.repeat(np.arange(BANDS * GROUPINGS, dtype=np.uint64)[None], len(some), 0)
                for k in range(ROWS):
                    bucket = mixed(bucket ^ drawn[:, :, k])
                for i, b in zip(some.tolist(), bucket.view(np.int64), strict=True):
                    bands[i] = b
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([hashlib.md5(t).digest() if t else None for t in texts], pa.binary()),  # as keyed() has it
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "bands"],
            )

    return map_batches(text_rows(docs), run, "doc_id long, key binary, bands array<long>")


def release(df: DataFrame) -> None:
    """Lets Spark's cleaner remove shuffles of rounds that nothing refers to; else they stay on disk until the driver's
    heap happens to fill."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def joined(rows: DataFrame, table: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows with table's columns but n; table has one row a key, n being the rows of that key. Keys with over a part in HOT
    of n_rows, HOT at most for each time that a row counts, go to every task; the other rows are shuffled."""
    bound = max(1, n_rows // HOT)
    hot = table.where(F.col("n") > bound).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col("n") <= bound).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each node of a task's own edges with the smallest one of its component there."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
    for k in range(0, len(rows), 100_000):
        part = rows[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], pa.binary()) for c in (0, 1)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component of edges (a, b). Alternating large and small stars over
    edges that every task has contracted by itself; each round is written to the shared folder in the place of the last
    one, and nothing but two numbers comes to the driver. Done when every node has one edge, to a node that has none."""
    contracted = lambda df: stored(map_batches(df.select("a", "b"), _contracted, "a binary, b binary"))
    current = contracted(edges)
    while True:
        ends = current.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            current.select("b", F.lit(0), F.lit(1))
        )
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, open_ = ends.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
        if not open_:
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        least = stored(least)
        large = joined(both.where("b > a"), least, "a", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct())
        below = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = joined(large, below, "a", n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        last, current = current, contracted(small)
        for gone in (last, least, large, below):
            delete_stored(gone)
        del both, least, large, below, small, last, ends
        release(current)


def linked(texts: list[bytes], weights: Weights, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of texts whose exact weighted Jaccard similarity reaches the threshold."""
    h, count, bounds = shingles(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # A shingle that occurs n times becomes n elements (shingle, 1..n) of its weight: shared weight is then the minimum.
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    weight = np.repeat(weights.of(h), count)
    owner = np.repeat(owner, count)
    element = np.repeat(h, count)
    element = np.where(nth > 0, mixed(element ^ mixed(nth.astype(np.uint64))), element)
    total = np.bincount(owner, weight, len(texts))
    order = np.lexsort((owner, element))
    element, own, w = element[order], owner[order], weight[order]
    fresh = np.flatnonzero(np.append(True, element[1:] != element[:-1])) if len(element) else np.zeros(0, np.int64)
    size = np.diff(np.append(fresh, len(element)))
    shared = size > 1
    fresh, size = fresh[shared], size[shared]
    # lists[fresh[i] : fresh[i] + size[i]]: the texts with element i; for each text the lists it is in
    member = np.repeat(np.arange(len(fresh)), size)
    place = np.repeat(fresh, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    by_text = np.argsort(own[place], kind="stable")
    cut = np.searchsorted(own[place][by_text], np.arange(len(texts) + 1))
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []
    for i in range(len(texts)):
        lists = by_text[cut[i] : cut[i + 1]]
        if not len(lists):
            continue
        of, at = member[lists], place[lists]
        n = size[of] - (at - fresh[of]) - 1  # texts after this one in each list
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        spot = np.repeat(at + 1, n) + inside
        common = np.bincount(own[spot], w[spot], len(texts))
        near = np.flatnonzero(common >= threshold * (total[i] + total - common) - 1e-9)
        for j in near[near > i].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((i, j))
    return forest


def verified(groups: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """(a, b): links of the tasks. groups: task, key, text, all rows of a task together in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, keys, texts = None, [], []

        def close() -> pa.RecordBatch:
            seen = {k: t for k, t in zip(keys, texts, strict=True)}
            names = sorted(seen)
            forest = linked([seen[k] for k in names], weights, threshold) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([names[p[x]] for p in forest], pa.binary()) for x in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            for t, k, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if t != task:
                    if len(keys) > 1:
                        yield close()
                    task, keys, texts = t, [], []
                keys.append(k)
                texts.append(x)
        if len(keys) > 1:
            yield close()

    return map_batches(groups, run, "a binary, b binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, class_id: one row per row of docs."""
    weights = learn_weights(docs)
    signed = stored(signatures(docs, weights))
    n_rows = signed.count()
    nodes = signed.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("first"), F.any_value("bands").alias("bands"), F.count("*").alias("n")
    )
    nodes = stored(nodes)
    buckets = nodes.where("bands is not null").select("key", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1")
    star = joined(buckets, shared, "bucket", n_rows).where("key <> b").select(F.col("key").alias("a"), "b")
    groups = components(star)
    wanted = groups.join(nodes.select(F.col("key").alias("node"), "first", "n"), "node").select(F.col("node").alias("key"), "root", "first", "n")
    text = keyed(docs).where("key is not null")
    # of a text that many rows share only the node's own rows are taken, and those are put together before the shuffle
    bound = max(1, n_rows // HOT)
    hot, rest = (wanted.where(c).drop("n") for c in (F.col("n") > bound, F.col("n") <= bound))
    own = F.col("doc_id").eqNullSafe(F.col("first"))
    of_hot = text.join(F.broadcast(hot), "key").where(own).groupBy("key", "root").agg(F.any_value("text").alias("text"))
    members = text.join(rest, "key").where(own).select("key", "root", "text").unionByName(of_hot)
    members = stored(members.select("key", "text", "root", F.length("text").alias("size")))
    sizes = members.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_BYTES)).cast("int").alias("tiles")
    )
    tiled = members.join(sizes, "root").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    # Each pair of tiles is a task; with one tile the group is the task. Two tiles at least make tasks of pairs i < j.
    tasks = F.when(
        F.col("tiles") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    ).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: x != F.col("tile")),
            lambda x: F.struct(F.least(x, "tile").alias("i"), F.greatest(x, "tile").alias("j")),
        )
    )
    dealt = (
        tiled.select("key", "text", "root", F.explode(tasks).alias("pair"))
        .select(F.xxhash64("root", "pair.i", "pair.j").alias("spread"), F.struct("root", "pair").alias("task"), "key", "text")
        .repartition("spread")
        .sortWithinPartitions("task")
        .select(F.concat_ws("/", F.hex("task.root"), "task.pair.i", "task.pair.j").alias("task"), "key", "text")
    )
    links = stored(verified(dealt, weights, threshold))
    roots = components(links).join(nodes.select(F.col("key").alias("node"), "first"), "node")
    smallest = roots.groupBy("root").agg(F.min("first").alias("class_id"), F.count("*").alias("n"))
    of_node = joined(roots.select("node", "root"), smallest, "root", n_rows).select(F.col("node").alias("key"), "class_id")
    of_key = nodes.select("key", "first", "n").join(of_node, "key", "left").select("key", F.coalesce("class_id", "first").alias("class_id"), "n")
    alone = signed.where("key is null").select("doc_id", "key", F.col("doc_id").alias("class_id"))
    whole = joined(signed.where("key is not null").select("doc_id", "key"), stored(of_key), "key", n_rows)
    return whole.select("doc_id", "key", "class_id").union(alone)


def without_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, without those of a class whose smallest doc_id is another row's.

    Of rows that repeat doc_id and text one stays; null and empty texts stay."""
    kept = classes(docs, threshold).where("key is not null and doc_id <=> class_id")
    row_id = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = kept.select(row_id("doc_id").alias("id"), "key")
    text = F.col("text").cast("binary")
    marked = docs.select(
        F.struct(*(F.col(c) for c in docs.columns)).alias("row"),
        row_id("doc_id").alias("id"),
        F.when(F.length(text) > 0, F.unhex(F.md5(text))).alias("key"),
    )
    once = marked.where("key is not null").groupBy("id", "key").agg(F.any_value("row").alias("row"))  # repeats meet before the shuffle
    rows = once.join(kept, ["id", "key"], "left_semi").select("row").union(marked.where("key is null").select("row"))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), n_class (its documents)."""
    found = stored(classes(read_table(spark, sf_dir, "documents")))
    size = found.groupBy("class_id").agg(F.count("*").alias("n")).withColumn("n_class", F.col("n"))
    return joined(found, stored(size), "class_id", found.count()).select("doc_id", "class_id", "n_class")
