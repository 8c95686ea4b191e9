"""Fuzzy line dedup by MinHash (operator 5).

Equal lines form one class by hash. A class's signature holds minima over all its character shingles, the set
that links are judged on. Bands of the signature bring candidate lines together; a pair is linked if the
Jaccard similarity of the full sets of character shingles is at least ``percent``. Lists of candidates are
joined without squares by ``simjoin``: short ones by pairs, long ones by a star around a central line and exact
deltas to it, so no link between components is lost. Of each component the first line stays (smallest doc_id,
then position); all others go.

Recall: BANDS bands of ROWS minima find a pair at the threshold with probability 1 - (1 - 0.8^6)^20 = 0.9977, one
at 85 % with 0.9999. Six rows keep chance meetings rare (a pair at 10 % meets with probability 2e-5); as they
grow with the square of the lines, a posting leaves where the postings are dealt, whatever the length of its list,
unless SOME of 64 two-bit minima outside its band agree with those of another line in the list (that loses a pair at
80 % with probability 9e-6 and leaves one chance meeting at 10 % in four million). Two bits of each minimum rule out
far pairs before lines are fetched (they lose a pair at 80 % with probability 1e-4). Keys have 32 bits: lists that
collide are one, so no pair is lost.

Signatures and set comparisons run in numpy on Arrow batches: in DataFrame functions alone they took over
three times the CPU time allowed (see the README). Everything else is joins and sums.

Defined results: blank lines always stay and are compared with nothing; a null text stays null; a document
all of whose lines go is dropped, and one that had no words before stays; rows that repeat doc_id and
text are one document; rows of a null doc_id sort first; an empty table gives no rows; ties go to the smaller
position; other columns stay, whatever their names. Lines are compared whole, whatever their length. A line is
known by a 64-bit hash: 10^10 different lines hold a colliding pair with a probability near one, 10^8 with 3e-4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simjoin
from .common import drop, fresh, keep, table
from .minhash import M1, PLUS, TIMES, agree, mix, two_bits

WIDTH, BANDS, ROWS, PERCENT = 5, 20, 6, 80
#: Minima of which two bits each are kept, and how many must agree; bands in one pass over the signatures.
FINE, AGREE, PASS = 128, 93, 2
#: How many of 64 two-bit minima outside a pass's bands must agree for two lines to keep each other in a list.
SOME = 41
SPACES = b" \t\n\v\f\r"


def chained(cp: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of WIDTH code points."""
    v = np.full(len(cp) - WIDTH + 1, np.uint64(WIDTH))
    for k in range(WIDTH):
        v += cp[k : k + len(v)]
        v = mix(v * M1)
    return v


def shingles(line: str) -> np.ndarray:
    """The sorted distinct character shingles of a line; a shorter line is its own shingle.

    A shingle of code points below 4,096 is packed into 60 bits, any other is hashed to a number above those.
    """
    cp = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    if len(cp) < WIDTH:
        cp = np.pad(cp, (0, WIDTH - len(cp)))
    wide = cp.astype(np.uint64)
    n = len(cp) - WIDTH + 1
    v = wide[:n].copy()
    for k in range(1, WIDTH):
        v <<= np.uint64(12)
        v |= wide[k : k + n]
    if cp.max() >= 4096:
        high = np.lib.stride_tricks.sliding_window_view(cp >= 4096, WIDTH).any(1)
        v[high] = chained(cp)[high] | np.uint64(1 << 63)
    v.sort()
    new = np.ones(n, bool)
    np.not_equal(v[1:], v[:-1], out=new[1:])
    return v[new]


def minima(lines: list[bytes], coords: int = FINE, wide: int = 64, step: int = 512) -> np.ndarray:
    """A row of ``coords`` minima for each line (none is empty), over all its character shingles."""
    gap = b"\n" * WIDTH  # so that the one window of a short line ends before the next line
    cp = np.frombuffer((gap.join(lines) + gap).decode().encode("utf-32-le"), np.uint32)
    end = np.flatnonzero(cp == 10)[::WIDTH]
    start = np.concatenate([[0], end[:-1] + WIDTH])
    count = np.maximum(end - start - (WIDTH - 1), 1)
    v = (chained(cp) >> np.uint64(32)).astype(np.uint32)
    # windows in segments of ``wide``, the last one of a line filled up with its last window
    segments = -(-count // wide)
    first = np.cumsum(segments) - segments
    line = np.repeat(np.arange(len(lines)), segments)
    at = start[line] + (np.arange(len(line)) - first[line]) * wide
    last = (start + count - 1)[line]
    out = np.empty((len(line), coords), np.uint32)
    for s in range(0, len(line), step):
        block = v[np.minimum(at[s : s + step] + np.arange(wide)[:, None], last[s : s + step])]
        own = np.empty_like(block)
        for k in range(coords):
            np.multiply(block, TIMES[k], out=own)
            own += PLUS[k]
            out[s : s + step, k] = own.min(0)
    return np.minimum.reduceat(out, first, axis=0)


def bands(low: np.ndarray) -> np.ndarray:
    """BANDS keys of each row of minima."""
    out = np.empty((len(low), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(low), np.uint64(b + 1))
        for k in range(b * ROWS, b * ROWS + ROWS):
            key = mix((key ^ low[:, k].astype(np.uint64)) * M1)
        out[:, b] = key
    return out.view(np.int64)


def lines_of(text: str | None) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that are not blank."""
    for pos, line in enumerate((text or "").encode().split(b"\n")):
        if line.strip(SPACES):
            yield pos, line


def named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, pos, h): a row for each line that is not blank, with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, pos, h = [], [], []
            for i, x in enumerate(b.column(2)):
                for p, line in lines_of(x.as_py()):
                    of.append(i)
                    pos.append(p)
                    h.append(xxhash.xxh64_intdigest(line, 42))
            own = [b.column(k).take(pa.array(of, pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pos, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))], names=["doc_id", "rid", "pos", "h"])

    return named(docs).mapInArrow(run, "doc_id long, rid long, pos int, h long")


def signatures(docs: DataFrame, seen_most: int = 100_000) -> DataFrame:
    """(id, k0 ..., f0 ...): hash, 32 bits of the band keys and two-bit minima of the lines; a worker skips lines that it has seen."""
    keys, longs = [f"k{b}" for b in range(BANDS)], [f"f{k}" for k in range(FINE // 32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def rows(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            low = minima([x for _, x in held])
            cols = [*np.ascontiguousarray(bands(low).astype(np.int32).T), *np.ascontiguousarray(two_bits(low).T)]
            h = np.array([x for x, _ in held], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), *map(pa.array, cols)], names=["id", *keys, *longs])

        for b in batches:
            held, size = [], 0
            for x in b.column(0):
                for _, line in lines_of(x.as_py()):
                    h = xxhash.xxh64_intdigest(line, 42)
                    if h not in seen:
                        if len(seen) >= seen_most:
                            seen.clear()
                        seen.add(h)
                        held.append((h, line))
                        size += len(line) + 64
                        if size > 1 << 20:
                            yield rows(held)
                            held, size = [], 0
            if held:
                yield rows(held)

    return docs.select("text").mapInArrow(run, ", ".join(["id long", *(f"{c} int" for c in keys), *(f"{c} long" for c in longs)]))


def copies(docs: DataFrame, ids: DataFrame, at: DataFrame) -> DataFrame:
    """(id, rid, text) of the lines whose hash is among ``ids``, from one document each; ``at`` are the places.

    The document is chosen on hashes, which are summed before they are sent: of a line that many documents hold
    the copies are dealt by document, so they do not meet in one task.
    """
    first = at.groupBy(F.col("h").alias("id")).agg(F.min("rid").alias("rid")).join(ids, "id", "left_semi")
    one = named(docs).select("rid", F.explode(F.split("text", "\n", -1)).alias("text")).withColumn("id", F.xxhash64("text"))
    return one.join(first, ["id", "rid"]).select("id", "rid", "text")


def texts_of(docs: DataFrame, ids: DataFrame, at: DataFrame) -> DataFrame:
    """(id, text) of the lines whose hash is among ``ids``."""
    return copies(docs, ids, at).groupBy("id", "rid").agg(F.min("text").alias("text")).select("id", "text")


def candidates(sigs: DataFrame) -> list[DataFrame]:
    """(key, id) of the lines that hold a key with another line like them, a table for each PASS bands."""
    lists = []
    for p in range(0, BANDS, PASS):
        own = [F.col(f"k{b}").cast("long").bitwiseAND(F.lit(2**32 - 1)) + F.lit(b << 32) for b in range(p, p + PASS)]
        keys = F.explode(F.array(*own)).alias("key")
        # two-bit minima that these bands do not hold
        held = range(p * ROWS // 32, ((p + PASS) * ROWS - 1) // 32 + 1)
        outside = [F.col(f"f{k}") for k in range(FINE // 32) if k not in held][-2:]
        # dealt once by key: each posting looks for another one where they lie, and the first that is alike ends the search
        posts = sigs.select("id", *(c.alias(f"f{k}") for k, c in enumerate(outside)), keys).repartition("key")
        other = posts.select(*(F.col(c).alias(f"{c}_") for c in posts.columns))
        alike = agree(*(F.array(f"f0{x}", f"f1{x}") for x in ("", "_")), 2) >= SOME
        met = posts.join(other.hint("shuffle_hash"), (F.col("key") == F.col("key_")) & (F.col("id") != F.col("id_")) & alike, "left_semi")
        lists.append(keep(met.select("key", "id").distinct(), "posts"))
    return lists


def roots_of(docs: DataFrame, at: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(node, root) of the line hashes that are linked to others; ``at`` are the places of all lines."""
    sigs = keep(signatures(docs), "linesigs")
    lists = candidates(sigs)
    posts = lists[0]
    for more in lists[1:]:
        posts = posts.union(more)
    n = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = keep(posts.join(n, "key").groupBy("id").agg(F.sum("n").alias("weight")), "weight")
    full = keep(posts.join(weight, "id").select("key", "id", "weight", F.lit(0).cast("long").alias("size")), "lists")
    longs = [f"f{k}" for k in range(FINE // 32)]
    fine = keep(sigs.join(weight.select("id"), "id", "left_semi").groupBy("id").agg(F.array(*(F.min(c) for c in longs)).alias("fine")), "fine")
    drop(sigs, weight, *lists)

    def alike(a: Column, b: Column) -> Column:
        return agree(a, b, FINE // 32) >= AGREE

    out = simjoin.links(full, lambda ids: texts_of(docs, ids, at), shingles, percent, sketches=fine.withColumnRenamed("fine", "sketch"), alike=alike)
    drop(fine)
    return out


def dropped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, rid, gone): the positions (from 0) of the lines that go, for documents that lose any."""
    at = keep(places(docs), "places")
    roots = roots_of(docs, at, percent)
    none = at.sparkSession.createDataFrame([], "h long, root long")
    roots = none if roots is None else roots.withColumnRenamed("node", "h")
    spread = [F.min("doc_id"), F.max("doc_id"), F.min("rid"), F.max("rid"), F.min("pos"), F.max("pos")]
    many = at.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *(c.alias(f"s{k}") for k, c in enumerate(spread)))
    many = many.where("n > 1 and not (s0 <=> s1 and s2 <=> s3 and s4 <=> s5)").select("h")
    group = many.select("h").union(roots.select("h")).distinct().join(roots, "h", "left").select("h", F.coalesce("root", "h").alias("root"))
    mine = keep(at.select("doc_id", "rid", "pos", "h").join(group, "h").select("doc_id", "rid", "pos", "root"), "grouped")
    first = mine.groupBy("root").agg(F.min(F.struct("doc_id", "pos", "rid")).alias("first"))
    gone = mine.join(first, "root").where(~F.struct("doc_id", "pos", "rid").eqNullSafe(F.col("first")))
    out = keep(gone.groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("gone")), "gone")
    drop(at, mine)
    return out


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the lines of ``text`` thinned; all other columns stay (n_chars follows the text)."""
    rid, own, id_, gone = (fresh(docs.columns, c) for c in ("rid", "own_rid", "own_id", "gone_lines"))
    lost = dropped(docs, percent).select(F.col("doc_id").alias(id_), F.col("rid").alias(own), F.col("gone").alias(gone))
    df = docs.withColumn(rid, F.xxhash64("doc_id", "text"))
    df = df.join(lost, (F.col(rid) == F.col(own)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    thin = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    df = df.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(thin))
    df = df.where(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = dropped(docs)
    out = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    out = out.join(gone.withColumnRenamed("doc_id", "gone_id"), "rid", "left").where("gone_id is null or gone_id <=> doc_id")
    n = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), n.alias("n_dropped"), F.concat_ws(",", F.array_sort("gone").cast("array<string>")).alias("dropped"))
