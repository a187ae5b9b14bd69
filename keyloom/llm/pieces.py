"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no vocabulary piece can reach over, so equal segments need be merged once. The distinct segments of
a block that are not yet known become one flat numpy array of symbols. Each round looks up the rank of every adjacent
pair, takes the minimum per segment, merges its places from the left, and compacts; a segment without a pair is done.
A merge whose product could at once be part of a pair of the same or a better rank is made at its leftmost place only,
so the order of merges is the library's.

Defined cases: a null text is an empty one and has the end id alone; a literal U+2581 is a space, as in the library;
characters outside the vocabulary become byte ids; a run of spaces of any length is exact. Rows that repeat a doc_id
are separate; an empty table gives none; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.common import blocks, map_batches, read_table, text_rows

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Segments that a worker remembers; it forgets all when there are more.
REMEMBERED = 150_000
#: Bytes of the longest segment that is remembered.
SHORT = 64


class Pieces:
    """The vocabulary and what follows from it. pieces: (text, score, kind), kind one of normal, byte, other."""

    def __init__(self, pieces: list[tuple[str, float, str]], end_id: int, unknown_id: int):
        self.end_id = end_id
        ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == "normal"}
        self.byte_id = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown_id = unknown_id
        self.surface = [
            bytes([int(text[3:5], 16)]) if kind == "byte" else text.replace(SPACE, " ").encode() if kind == "normal" else b""
            for text, _, kind in pieces
        ]
        self.is_byte = np.array([kind == "byte" for _, _, kind in pieces])
        #: Symbols: pieces by id, then characters that occur in pieces only.
        self.symbols = dict(ids)
        extra = sorted({c for text in ids for c in text} - ids.keys())
        self.symbols.update((c, len(pieces) + k) for k, c in enumerate(extra))
        self.size = len(pieces) + len(extra)
        score = {i: pieces[i][1] for i in ids.values()}
        rank_of = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        keys, product, rank = [], [], []
        best = np.full(self.size, 2**31 - 1, np.int64)
        for text, i in ids.items():
            for cut in range(1, len(text)):
                a, b = self.symbols.get(text[:cut]), self.symbols.get(text[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    product.append(i)
                    rank.append(rank_of[score[i]])
                    for x in (a, b):
                        best[x] = min(best[x], rank[-1])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.product = np.array(product, np.int64)[order]
        self.rank = np.array(rank, np.int64)[order]
        own = np.full(self.size, -1, np.int64)
        for i, s in score.items():
            own[i] = rank_of[s]
        self.careful = best <= own  # a product that may at once merge on, before other places of its own rank
        self.none = len(rank_of)
        self._rules(ids)

    def _rules(self, ids: dict[str, int]) -> None:
        """Between letters and other ASCII, and before a space, no piece reaches over; odd characters do not keep to it."""
        odd = set()
        for text in ids:
            for a, b in zip(text, text[1:], strict=False):
                if b == SPACE and a != SPACE:
                    raise ValueError("pieces with an inner space are not supported")
                if a != SPACE and self._plain(a) != self._plain(b):
                    odd |= {a, b}
        ascii_odd = {c for c in odd if c.isascii() and c.isalpha()}
        self.odd = re.compile(b"|".join(re.escape(c.encode()) for c in sorted(odd) if not c.isascii()) or b"(?!)")
        fine = rb" *(?:[A-Za-z\x80-\xff]+|[^A-Za-z\x80-\xff ]+)| +"
        self.coarse = re.compile(rb" *[^ ]+| +")
        self.fine = self.coarse if ascii_odd else re.compile(fine)

    @staticmethod
    def _plain(c: str) -> bool:
        return not (c.isascii() and not c.isalpha())

    def segments(self, text: bytes) -> list[bytes]:
        """The text with the dummy prefix, cut; joined again they are the same bytes."""
        if not text:
            return []
        text = b" " + text.replace(SPACE_BYTES, b" ")
        return (self.coarse if self.odd.search(text) else self.fine).findall(text)

    def spaces(self, n: int) -> tuple[int, int]:
        """How many groups of 16 spaces the leftmost merges of a long run of n end with, and what is left to merge."""
        width = 16 if SPACE * 16 in self.symbols else 0
        groups = max(0, n - 32) // width if width else 0
        return groups, n - groups * width

    def encode(self, segments: list[bytes]) -> list[np.ndarray]:
        """Ids of each segment."""
        heads: list[int] = []
        chars: list[str] = []
        lengths = []
        for s in segments:
            text = s.decode("utf-8", "replace")
            groups = 0
            if text.startswith(" " * 64):
                body = text.lstrip(" ")
                groups, rest = self.spaces(len(text) - len(body))
                text = " " * rest + body
            heads.append(groups)
            chars.append(text)
            lengths.append(len(text))
        flat = "".join(chars).replace(" ", SPACE)
        known = self.symbols
        unseen: dict[str, int] = {}
        symbol = np.fromiter(
            (known[c] if c in known else -1 - unseen.setdefault(c, len(unseen)) for c in flat), np.int64, len(flat)
        )
        owner = np.repeat(np.arange(len(segments)), lengths)
        done_symbols, done_owners = [], []
        while len(symbol):
            key = np.where(
                (owner[:-1] == owner[1:]) & (symbol[:-1] >= 0) & (symbol[1:] >= 0), symbol[:-1] * self.size + symbol[1:], -1
            )
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            pair_rank = np.where(self.keys[at] == key, self.rank[at], self.none)
            rank = np.append(pair_rank, self.none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.diff(np.append(first, len(owner)))
            n = len(symbol)
            least = np.minimum.reduceat(rank * n + np.arange(n), first)
            best, place = least // n, least % n
            going = best < self.none
            if not going.all():
                out = np.repeat(~going, count)
                done_symbols.append(symbol[out])
                done_owners.append(owner[out])
                if not going.any():
                    break
            chosen = rank == np.repeat(np.where(going, best, -1), count)
            where = np.flatnonzero(chosen)
            product = self.product[at[where]]
            single = self.careful[product] & (where != np.repeat(place, count)[where])
            where, product = where[~single], product[~single]
            run = np.cumsum(np.append(True, where[1:] != where[:-1] + 1))
            inside = np.arange(len(where)) - np.searchsorted(run, run)
            even = inside % 2 == 0  # of overlapping places each second one, from the left
            where, product = where[even], product[even]
            symbol[where] = product
            keep = np.repeat(going, count)
            keep[where + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        symbol = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        owner = np.concatenate(done_owners) if done_owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        symbol, owner = symbol[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(len(segments) + 1))
        odd = np.append(0, np.cumsum((symbol < 0) | (symbol >= len(self.surface))))
        names = list(unseen)
        extra = {v: k for k, v in known.items() if v >= len(self.surface)}
        out: list[np.ndarray] = []
        for k, head in enumerate(heads):
            a, b = bounds[k], bounds[k + 1]
            ids = symbol[a:b]
            if odd[b] > odd[a]:
                found: list[int] = []
                for x in ids.tolist():
                    if 0 <= x < len(self.surface):
                        found.append(x)
                    else:
                        c = names[-1 - x] if x < 0 else extra[x]
                        found += [self.byte_id.get(y, self.unknown_id) for y in c.encode()]
                ids = np.array(found, np.int64)
            if head:
                ids = np.concatenate([np.full(head, known[SPACE * 16], np.int64), ids])
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of ids without the dummy prefix's removal; bytes that are no UTF-8 become U+FFFD one by one."""
        if not self.is_byte[ids].any():
            return b"".join([self.surface[i] for i in ids])
        out, pending = [], bytearray()
        for i in ids.tolist():
            if self.is_byte[i]:
                pending += self.surface[i]
                continue
            out += [_utf8(pending), self.surface[i]]
            pending = bytearray()
        return b"".join([*out, _utf8(pending)])


def _utf8(raw: bytes | bytearray) -> bytes:
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[k : k + n]).decode().encode())
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            k += 1
    return b"".join(out)


class Codec:
    """Encodes and decodes whole texts; remembers segments."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.ids: dict[bytes, bytes] = {}
        self.texts: dict[bytes, bytes] = {}

    def learn(self, segments: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Encodes segments that are not remembered; long ones are returned only."""
        if len(self.ids) > REMEMBERED:
            self.ids, self.texts = {}, {}
        new = [s for s in segments if s not in self.ids]
        passing = {}
        for s, ids in zip(new, self.pieces.encode(new), strict=True):
            written = b" ".join([b"%d" % i for i in ids.tolist()])
            back = self.pieces.decode(ids)
            back = s if back == s else back
            if len(s) <= SHORT:
                self.ids[s], self.texts[s] = written, back
            else:
                passing[s] = (written, back)
        return passing

    def block(self, texts: list[bytes | None]) -> Iterator[tuple[bytes, bytes]]:
        """(decimal ids joined by one space, decoded text) of each text, in order, with the end id."""
        if len(self.ids) > REMEMBERED:
            self.ids, self.texts = {}, {}
        cut = [self.pieces.segments(t or b"") for t in texts]
        passing = self.learn(set().union(*cut))
        end = b"%d" % self.pieces.end_id
        for segments in cut:
            if passing and not passing.keys().isdisjoint(segments):
                ids = [passing[s][0] if s in passing else self.ids[s] for s in segments]
                back = [passing[s][1] if s in passing else self.texts[s] for s in segments]
            else:
                ids, back = list(map(self.ids.__getitem__, segments)), map(self.texts.__getitem__, segments)
            ids.append(end)
            yield b" ".join(ids), b"".join(back)[1:]


def load(model_file: str) -> Pieces:
    """Reads the vocabulary of a model file on the driver."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    kind = lambda i: (
        "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"
    )
    pieces = [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]
    return Pieces(pieces, model.eos_id(), model.unk_id())


def encode_documents(docs: DataFrame, pieces: Pieces, digests: bool = False) -> DataFrame:
    """doc_id, ids array<int>, decoded string; or, with digests, doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces)
        for keys, texts in blocks(batches):
            done = codec.block(texts)
            if digests:
                rows = [
                    (i.count(b" ") + 1, hashlib.sha256(i).hexdigest(), hashlib.sha256(t).hexdigest()) for i, t in done
                ]
                names, kinds = ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]
            else:
                rows = [(np.fromstring(i, np.int32, sep=" "), t.decode()) for i, t in done]
                names, kinds = ["ids", "decoded"], [pa.list_(pa.int32()), pa.string()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *columns], names=["doc_id", *names])

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return map_batches(text_rows(docs), run, f"doc_id long, {schema}")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), load(model_path()), digests=True)
