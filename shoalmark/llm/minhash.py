"""MinHash near-duplicates by a signature-coordinate inverted join (operator 6).

A document's set holds the shingles of ``width`` words (64-bit hashes of lower-cased words chained).
Documents with equal sets form one class first, so copies are never paired. Each class has a signature
of COORDS minima and is posted under each (coordinate, value). The join then works like a
prefix-and-skip merge of posting lists:

* coordinates that nobody shares are dropped, and classes that share fewer than ``match`` go;
* a pair that matches in ``match`` of its m shared coordinates meets in one of the m - match + 1 rarest
  of either, so only that prefix is joined and the long lists are skipped: their collisions are counted
  on the two signatures;
* pairs at or above ``match`` are confirmed exactly on full sets, after two bits of each of FINE more
  coordinates have ruled out most pairs below the threshold.

Lists are joined without squares by ``simjoin``: short ones by pairs, long ones by a star around their most
central member and exact deltas to it, so that every link between different components is found.

Recall: the number of matching coordinates of a pair is binomial. With 32 coordinates and a match of 17, a pair
right at 80 % is missed with probability 4e-4, one at 85 % with 6e-6 (the finer coordinates add 4e-5); at 100 TB raise both in proportion.

Defined results: null or word-less texts have the empty set, stand alone (n_shingles 0) and link with
nothing; texts with fewer words than ``width`` have their whole word sequence as the one shingle;
rows that repeat a doc_id are rows of one document: each keeps its own set, and all of them are in one
component; null doc_ids are returned unlinked and kept; an empty table gives no rows; the longest text is one
row of a task, read whole; other columns are not touched. The component id is the smallest doc_id that is
reachable, so ties cannot occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simjoin
from .common import components, drop, keep, table

COORDS, MATCH = 32, 17
#: Coordinates of which two bits each are kept, to tell far pairs before texts are fetched, and how many must agree.
FINE, AGREE = 256, 194
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SALTS = np.random.default_rng(20240501).integers(0, 2**64, 512, dtype=np.uint64)
TIMES = ((SALTS & np.uint64(0xFFFFFFFF)) | np.uint64(1)).astype(np.uint32)
PLUS = (SALTS >> np.uint64(32)).astype(np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(29))


class Memo(dict):
    """Hashes of words; emptied when it holds ``limit`` of them."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


MEMO = Memo()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(MEMO.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out += h[k : k + n]
        out = mix(out * M1)
    return np.unique(out)


def signature(s: np.ndarray, coords: int, step: int = 2048) -> np.ndarray:
    """Minima of ``coords`` hash functions, 32 bits each."""
    v = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(coords, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(v), step):
        np.minimum(out, (v[k : k + step] * TIMES[:coords, None] + PLUS[:coords, None]).min(1), out=out)
    return out


def two_bits(minima: np.ndarray) -> np.ndarray:
    """Bits 8 and 9 of each minimum, 32 of them in each long (rows of 32 n minima give n longs)."""
    x = (minima >> np.uint32(8) & np.uint32(3)).astype(np.uint64).reshape(*minima.shape[:-1], -1, 32)
    return (x << np.arange(0, 64, 2, dtype=np.uint64)).sum(-1, dtype=np.uint64).view(np.int64)


def agree(a: Column, b: Column, longs: int) -> Column:
    """How many two-bit fields of two arrays of longs are equal."""
    apart = [a[i].bitwiseXOR(b[i]) for i in range(longs)]
    odd = F.lit(0x5555555555555555)
    return 32 * longs - sum((F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(odd)) for x in apart), F.lit(0))


def signatures(docs: DataFrame, width: int, coords: int = COORDS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, mark, sig, fine) of each row.

    Two 64-bit hashes name the set, mark is a hash of the text; sig and fine are null when the set is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, names, sigs, fine = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), width)
                n.append(len(s))
                names.append(xxhash.xxh3_128_intdigest(s.tobytes()))
                got = signature(s, coords + FINE) if len(s) else None
                sigs.append(None if got is None else got[:coords].view(np.int32))
                fine.append(None if got is None else two_bits(got[coords:]))
            half = [np.array([(d >> k) & (2**64 - 1) for d in names], np.uint64).view(np.int64) for k in (64, 0)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), *map(pa.array, half), b.column(2), pa.array(sigs, pa.list_(pa.int32())), pa.array(fine, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "mark", "sig", "fine"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, mark long, sig array<int>, fine array<long>")


def prefix_lists(classes: DataFrame, match: int = MATCH) -> DataFrame:
    """(key, id, weight): the postings of the rarest coordinates, without lists of one."""
    posts = classes.select("id", F.col("n_shingles").alias("size"), F.posexplode("sig").alias("k", "v")).select(
        "id", "size", F.expr("shiftleft(cast(k as bigint), 32) | (cast(v as bigint) & 4294967295)").alias("key")
    )
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = simjoin.prefix(posts.join(shared, "key"), ["id", "size"], F.max(F.lit(match)))
    return cut.select("key", "id", F.col("sum").alias("weight"), "size")


def roots_of(docs: DataFrame, classes: DataFrame, width: int, percent: int, match: int = MATCH) -> DataFrame | None:
    """(node, root) of the classes (id, rep, mark, n_shingles, sig, fine) that are similar to others."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")

    def fetch(ids: DataFrame) -> DataFrame:
        one = classes.join(ids, "id", "left_semi").select("id", "rep", "mark")
        both = texts.join(one, "rep").where(F.xxhash64("text") == F.col("mark"))
        return both.groupBy("id").agg(F.min("text").alias("text"))

    def alike(a: Column, b: Column) -> Column:
        """Count collisions on the signatures."""
        same = F.aggregate(F.zip_with(a["sig"], b["sig"], lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
        return (agree(a["fine"], b["fine"], FINE // 32) >= AGREE) & (same >= match)

    sketches = classes.select("id", F.struct("sig", "fine").alias("sketch"))
    lists = keep(prefix_lists(classes, match), "prefix")
    return simjoin.links(lists, fetch, lambda t: shingles(t, width), percent, sketches=sketches, alike=alike)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, match: int = MATCH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept (the smallest doc_id of its component)."""
    sigs = keep(signatures(docs, width).withColumn("id", F.when(F.col("sig").isNotNull() & F.col("doc_id").isNotNull(), F.xxhash64("set_a", "set_b"))), "sigs")
    first = F.min(F.struct("doc_id", "mark"))
    classes = keep(
        sigs.where("id is not null").groupBy("id").agg(first["doc_id"].alias("rep"), first["mark"].alias("mark"), F.first("sig").alias("sig"), F.first("fine").alias("fine"), F.first("n_shingles").alias("n_shingles")),
        "classes",
    )
    roots = roots_of(docs, classes, width, percent, match)
    # rows of one document are connected, whatever their texts
    rows = sigs.where("id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    rows = sigs.where("id is not null").join(rows, "doc_id").select("a", F.col("id").alias("b")).where("a <> b")
    if not rows.isEmpty():
        was, roots = roots, components(rows if roots is None else rows.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        drop(was)
    names = classes.select("id", "rep")
    if roots is not None:
        names = names.join(roots.withColumnRenamed("node", "id"), "id", "left")
        least = names.where("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
        names = names.join(least, "root", "left").select("id", F.coalesce("least", "rep").alias("rep"))
    out = sigs.select("doc_id", "n_shingles", "id").join(names, "id", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    out = out.select("doc_id", "n_shingles", comp.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


#: Exact components by all pairs that share a shingle; small tables only.
ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
    else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n na on na.doc_id = x join n nb on nb.doc_id = y where 100 * k >= 80 * (na.n + nb.n - k)),
r as (select doc_id as x, doc_id as y from w union select r.x, e.y from r join e on r.y = e.x),
c as (select x as doc_id, min(y) as component_id from r group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from w left join n using (doc_id) join c using (doc_id)
"""
