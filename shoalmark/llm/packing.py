"""Packing documents into fixed sequences by harmonic classes (operator 8).

A document's ids beyond whole sequences of ``capacity`` C are its rest. A rest of r ids belongs to class k with
C/(k+1) < r <= C/k, and a bin of class k < CLASSES takes exactly k of them, whole, so bins never need to be
searched and each worker fills its own. What k rests leave free is the bin's gap. Rests of the last class, at
most C/CLASSES ids, fill the gaps in order of arrival: whole where they fit, and one is cut where the gap ends.
If bins with gaps pile up (WAITING of them) the next rest fills gaps, whatever its class. At a worker's end the bins
that are still open are laid end to end as whole sequences; the last part is cut into powers of two.

So no sequence holds padding, and a bin adds one cut at most: a table has about as many pieces as documents and
sequences together, and only documents at a gap's end or longer than a sequence are cut.

Special tokens in a text are found as the library finds them. Defined results: a null text counts as empty and
yields the closing id alone; a document of no rest has whole sequences only; an empty table gives no rows; ties
and repeated rows are packed each, rows of a null doc_id too; other columns are not read; a very long text is
one row of a task. Pieces of a document appear in any order of sequences. Sequence ids are unique: worker number
times 2^33 plus a counter. A worker that is run again packs the same input partition and gives the same ids as
long as that partition comes in the same order, which holds for scans of files. A worker holds its open bins:
at most CLASSES rests a class, and WAITING bins.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkCache
from .common import table

CAPACITY, CLASSES, WAITING = 2048, 16, 32
CLOSING_ID = 1
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_signs() -> dict[int, str]:
    """The printable sign of each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def coder(path: str | None) -> ChunkCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or P.path(VOCABULARY))
    model = t.model
    signs = byte_signs()

    def many(texts: list[str]) -> list[bytes]:
        # a space and letters are one pre-token, so the model can be asked without the steps before it
        out: list = [None] * len(texts)
        rest = []
        for k, x in enumerate(texts):
            if x[:1] == " " and x[1:].isalpha():
                word = "Ġ" + x[1:] if x.isascii() else x.encode().decode("latin-1").translate(signs)
                out[k] = array("I", [token.id for token in model.tokenize(word)]).tobytes()
            else:
                rest.append(k)
        got = t.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)
        for k, e in zip(rest, got):
            out[k] = array("I", e.ids).tobytes()
        return out

    return ChunkCache(many)


class Harmonic:
    """The bins of one worker. A part is (doc, start, ids as bytes, doc_tokens); rows gets SCHEMA's tuples."""

    def __init__(self, worker: int, capacity: int = CAPACITY, classes: int = CLASSES, waiting: int = WAITING):
        self.next, self.capacity, self.classes, self.most = worker << 33, capacity, classes, waiting
        self.rows: list[tuple] = []
        self.bins: dict[int, list] = {}
        self.gaps: deque[list] = deque()  # bins of k rests, with a gap
        self.small: deque[tuple] = deque()

    def close(self, parts: list[tuple]) -> None:
        """One sequence of ``parts``."""
        at = 0
        for doc, start, raw, total in parts:
            n = len(raw) // 4
            self.rows.append((doc, start, n, zlib.crc32(raw), total, self.next, at))
            at += n
        self.next += 1

    @staticmethod
    def take(parts: deque[tuple], size: int) -> list[tuple]:
        """Parts of at most ``size`` ids off the front; the last one is cut if it does not fit."""
        out = []
        while size and parts:
            doc, start, raw, total = parts.popleft()
            n = min(size, len(raw) // 4)
            out.append((doc, start, raw[: 4 * n], total))
            if 4 * n < len(raw):
                parts.appendleft((doc, start + n, raw[4 * n :], total))
            size -= n
        return out

    def add(self, doc, raw: bytes) -> None:
        """One document with its closing id."""
        total, size = len(raw) // 4, self.capacity
        whole = total // size * size
        for at in range(0, whole, size):
            self.close([(doc, at, raw[4 * at : 4 * (at + size)], total)])
        r = total - whole
        if not r:
            return
        part = (doc, whole, raw[4 * whole :], total)
        k = min(self.classes, size // r)
        if k == self.classes or len(self.gaps) >= self.most:
            self.small.append(part)
        else:
            held = self.bins.setdefault(k, [])
            held.append(part)
            if len(held) < k:
                return
            self.gaps.append(self.bins.pop(k))
        self.fill()

    def fill(self) -> None:
        """Lay the small rests into the gaps; those of a class that no gap takes make bins of their own."""
        while self.gaps:
            held = self.gaps[0]
            free = self.capacity - ids_in(held)
            held += self.take(self.small, free)
            if ids_in(held) < self.capacity:
                break
            self.close(self.gaps.popleft())
        if ids_in(self.small) >= self.capacity:
            self.close(self.take(self.small, self.capacity))

    def end(self) -> None:
        for held in [*self.gaps, *self.bins.values()]:
            self.small.extend(held)
        left = ids_in(self.small)
        while left:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            self.close(self.take(self.small, size))
            left -= size


def ids_in(parts) -> int:
    return sum(len(p[2]) for p in parts) // 4


def pack(docs: DataFrame, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, path: str | None = None) -> DataFrame:
    """Pack all rows of (doc_id, text); one output row per piece (see SCHEMA)."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    tail = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = coder(path)
        bins = Harmonic(TaskContext.get().partitionId(), capacity)

        def flush() -> pa.RecordBatch:
            cols = [pa.array(x, pa.int64()) for x in zip(*bins.rows)]
            bins.rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), cache.encode(t or "" for t in b.column(1).to_pylist())):
                bins.add(doc, raw + tail)
                if len(bins.rows) >= 20_000:
                    yield flush()
        bins.end()
        if bins.rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
