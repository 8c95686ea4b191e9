"""Byte-level BPE encoding and decoding by ranks (operator 1).

Pre-tokens are merged with a rank queue: one bucket per merge rank holds the positions (starts of the left token in
a linked list) whose pair has that rank; a bitmap in two levels says which buckets are filled, and find-first-set
on it gives the next rank. Entries are never removed when a neighbour merges; a popped entry whose pair has
changed since is stale and skipped. All new pre-tokens of about ``step`` characters of text are one list, so a
bucket holds many positions and is merged at once. The work is O(n) bucket entries and O(log vocabulary) a pair.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; special
tokens in a text are ordinary text. Rows, ties and repeated rows pass through one by one, so the
output has one row per input row; other columns of the input stay, but for clashes with the new names,
which are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkCache
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class RankQueue:
    """Buckets of positions by rank, and a bitmap of two levels of the filled ones: 256 ranks a word, any number of words."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (ranks // 256 + 1)
        self.top = 0  # bit t: some rank of word low[t] has entries

    def push(self, rank: int, positions: list[int]) -> None:
        """A new bucket."""
        self.buckets[rank] = positions
        self.low[rank >> 8] |= 1 << (rank & 255)
        self.top |= 1 << (rank >> 8)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest filled rank, by find-first-set on both levels, and all its positions."""
        t = (self.top & -self.top).bit_length() - 1
        w = self.low[t]
        rank = (t << 8) + (w & -w).bit_length() - 1
        self.low[t] = w = w & (w - 1)
        if not w:
            self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.lengths = np.zeros(self.size, np.int64)
        self.lengths[list(ranks.values())] = [len(b) for b in ranks]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.text = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        self.whole = {b: i.to_bytes(4, "little") for b, i in ranks.items()}  # pre-tokens that are one token
        # all ways to cut a token into two tokens, as left * size + right, in order
        cuts = {(ranks[b[:k]] * self.size + ranks[b[k:]]): r for b, r in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}
        self.pairs = np.array(sorted(cuts), np.int64)
        self.merged = np.array([cuts[x] for x in self.pairs.tolist()] + [-1], np.int64)
        self.pairs = np.append(self.pairs, np.iinfo(np.int64).max)
        self.cache = ChunkCache(self._many, 300_000)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, -1 where they do not merge."""
        key = left * self.size + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian uint32. All are merged together, as one linked list in which no pair crosses their ends.

        What has the lowest rank anywhere has it in its own pre-token too, so a bucket's positions are merged at
        once; where they overlap (aaa) every second one of a run is.
        """
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        ends = np.cumsum([len(p) for p in pieces])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n  # n: the end of a pre-token
        before[ends[:-1]] = -1
        token = np.append(token, 0)
        before = np.append(before, 0)
        pair = np.append(self.rank_of(token[:-1], token[np.minimum(after, n)]), -1)
        pair[ends - 1] = -1
        live = np.ones(n, bool)  # places where a token starts
        queue = RankQueue(self.size)
        start = np.flatnonzero(pair >= 0)
        start = start[np.argsort(pair[start], kind="stable")]
        rank, begin = np.unique(pair[start], return_index=True)
        for r, held in zip(rank.tolist(), np.split(start, begin[1:])):
            queue.push(r, held.tolist())
        buckets, push = queue.buckets, queue.push
        while queue.top:
            r, held = queue.pop()
            i = np.array(held)
            i = i[pair[i] == r]  # the others are stale
            if not len(i):
                continue
            if len(i) > 1:
                i = np.unique(i)
                meets = after[i[:-1]] == i[1:]
                if meets.any():
                    run = np.arange(len(i))
                    begin = np.concatenate([[True], ~meets])
                    run -= np.maximum.accumulate(np.where(begin, run, 0))
                    i = i[run % 2 == 0]
            j = after[i]
            k = after[j]
            after[i] = k
            before[k] = i
            token[i] = r
            pair[j] = -1
            live[j] = False
            p = before[i]
            one, two = np.flatnonzero(k < n), np.flatnonzero(p >= 0)
            right = np.full(len(i), -1)
            right[one] = self.rank_of(token[i[one]], token[k[one]])
            pair[i] = right
            p = p[two]
            left = self.rank_of(token[p], token[i[two]])
            pair[p] = left
            new, at = np.concatenate([right, left]), np.concatenate([i, p])
            good = new >= 0
            for r, x in zip(new[good].tolist(), at[good].tolist()):
                if r in buckets:
                    buckets[r].append(x)
                else:
                    push(r, [x])
        raw = token[:-1][live].astype("<u4").tobytes()
        stop = 4 * np.cumsum(live)[ends - 1]
        return [raw[s:e] for s, e in zip([0, *stop[:-1].tolist()], stop.tolist())]

    def _many(self, texts: list[str]) -> list[bytes]:
        get, pieces = self.whole.get, self.pieces
        out: list[list[bytes | None]] = []
        open_, at = [], []
        for t in texts:
            ids = []
            for p in (t,) if t[1:].isalpha() and t[0] == " " else pieces(t):
                b = p.encode()
                r = get(b)
                if r is None:
                    open_.append(b)
                    at.append((ids, len(ids)))
                ids.append(r)
            out.append(ids)
        if open_:
            for (ids, k), got in zip(at, self.merge(open_)):
                ids[k] = got
        return [ids[0] if len(ids) == 1 else b"".join(ids) for ids in out]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after another, as uint8."""
        size = self.lengths[ids]
        begin = self.starts[ids] - (np.cumsum(size) - size)
        return self.text[np.repeat(begin, size) + np.arange(size.sum())]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The coder of a worker, with its cache; the rank file is read where the worker runs."""
    import public_tokenizers as P

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Bpe(ranks, P.PATTERN)


def _path(path: str | None) -> str:
    import public_tokenizers as P

    return path or P.path(VOCABULARY)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``ids`` (array<int>): the ids of each whole text."""
    rest = [c for c in docs.columns if c not in (text, ids)]
    schema = docs.select(*rest, F.array(F.lit(0)).alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(_path(path))
        for b in batches:
            lens, parts = [0], []
            at, held = 0, 0
            for i, raw in enumerate(coder.cache.encode(t or "" for t in b.column(len(rest)).to_pylist())):
                parts.append(raw)
                lens.append(lens[-1] + len(raw) // 4)
                held += len(raw)
                if held > 1 << 24 or i == b.num_rows - 1:
                    flat = pa.array(np.frombuffer(b"".join(parts), "<u4").astype("i4"))
                    col = pa.ListArray.from_arrays(pa.array(lens, pa.int32()), flat)
                    own = [b.column(k).slice(at, len(parts)) for k in range(len(rest))]
                    yield pa.RecordBatch.from_arrays([*own, col], names=[*rest, ids])
                    at, held, lens, parts = i + 1, 0, [0], []

    return docs.select(*rest, text).mapInArrow(run, schema)


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Replace-or-add ``out`` (binary): the bytes that the ids stand for; null ids give no bytes."""
    rest = [c for c in docs.columns if c != out]
    schema = docs.select(*rest, F.lit(b"").alias(out)).schema
    at = rest.index(ids)

    def pieces(b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        """The batch in runs of rows of about ``most`` ids."""
        done = np.cumsum(pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + most, "right")))
            yield b.slice(start, end - start)
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(_path(path))
        for b in batches:
            for rows in pieces(b):
                col = rows.column(at)
                count = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                flat = col.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(coder.lengths[flat])])[np.concatenate([[0], np.cumsum(count)])]
                data = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(coder.decode(flat))]
                got = pa.Array.from_buffers(pa.binary(), rows.num_rows, data)
                yield pa.RecordBatch.from_arrays([*rows.columns, got], names=[*rest, out])

    return docs.select(*rest).mapInArrow(run, schema)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
