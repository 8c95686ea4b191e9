"""Links of similar sets from candidate lists, without all pairs of a list (operators 5 and 6).

A list is a key with the members that hold it; any pair worth a look shares a list. Two steps:

* a list of at most PAIRS members gives its pairs; one of at most ``few`` only compares all with its heaviest,
  which connects most, and gives the pairs that are still unconnected in the second step;
* a longer one gives a star: each member is compared with the list's heaviest member and with its centre c only,
  the heaviest of this and neighbouring lists. The latter also
  yields the member's delta, the elements that x and c do not share, dx.

What a star leaves open is settled exactly by deltas. With D(x, y) the number of elements that x and y do
not share, the similarity is at least p % if and only if (100 + p) D(x, y) <= (100 - p) (|x| + |y|), and
D(x, y) = |dx| + |dy| - 2 |dx and dy|. Let e(x) = (100 + p) |dx| - (100 - p) |x|; then x and y are similar if
and only if |dx and dy| >= (e(x) + e(y)) / (2 (100 + p)). The members of a centre are dealt by size into blocks of
about MEMBERS; blocks meet in twos, where sizes allow a link and not both are connected to the centre already. In a
meeting all |dx and dy| are counted at once (rare elements by their holders, frequent ones by a product of
matrices), and only links that connect what is not yet connected are rows.

Rows made: at most ``few`` pairs a posting in short lists, one star row a posting, and of the members of a centre
one for each block that its own meets. The latter are sent in rounds of about SENT times the members, so disk
grows with the members and not with the square of a family. The work of a centre still is the square of its members, in numpy on blocks:
pairs around the threshold are told apart by counting only, but they are neither rows nor fetched as texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop, keep

PAIRS, FEW = 8, 64
#: Members and delta elements of a block, about; pairs of holders up to which an element is counted by them.
MEMBERS, ELEMENTS, SPARSE = 1024, 400_000, 1_000
#: What is sent to block meetings in a round: so many times all delta elements, or so many elements if that is more.
SENT, SENT_LEAST = 4, 20_000_000
IN, OUT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

Shingler = Callable[[str], np.ndarray]
Alike = Callable[[Column, Column], Column]


def prefix(posts: DataFrame, owner: list[str], need) -> DataFrame:
    """Of the postings (owner..., key, n) of each owner the rarest k - need + 1, for owners with k >= need.

    Two owners that share ``need`` of their keys meet in one of these. ``k`` is the number of an owner's keys, ``sum`` that of their n.
    """
    per = posts.groupBy(*owner).agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"), need.alias("need"))
    total = F.aggregate("keys", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    per = per.where("size(keys) >= need").select(*owner, total.alias("sum"), F.size("keys").alias("k"), F.explode(F.expr("slice(keys, 1, size(keys) - need + 1)")).alias("x"))
    return per.select(*owner, "sum", "k", "x.key")


def _pairs(
    lists: DataFrame, roots: DataFrame | None, few: int, up: int, sketches: DataFrame | None, alike: Alike | None
) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, star): the comparisons of a step; in a star b is the centre. Beside it the lists that wait for the second step."""
    first = roots is None
    state = lists.select("key", "id", "weight", "size")
    state = state.withColumn("root", F.col("id")) if first else (
        state.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    )
    span = state.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.max(F.struct("weight", "id")).alias("top")).where("lo < hi")
    state = keep(state.join(span.select("key", "n", "top"), "key"), "state")
    # the sketches sit in the lists, so a pair that they rule out is never a row
    short = state.where(F.col("n") <= (PAIRS if first else few))
    short = short.withColumn("sketch", F.lit(0)) if sketches is None else short.join(sketches, "id")
    # short lists with the same members are one list
    short = short.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "root", "size", "sketch"))).alias("m")).select("m").distinct()
    x = F.col("x")

    def fits(y: Column) -> Column:
        sums = (x["root"] != y["root"]) & (100 * F.least(x["size"], y["size"]) >= (up - 100) * F.greatest(x["size"], y["size"]))
        return sums if alike is None else sums & alike(x["sketch"], y["sketch"])

    short = short.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.filter(F.expr("slice(m, i + 2, size(m))"), fits)).alias("y"))
    short = short.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(0).alias("star"))
    if not first:
        pairs = keep(short.distinct(), "pairs")
        drop(state)
        return pairs, None

    def sieved(pairs: DataFrame) -> DataFrame:
        if sketches is None or alike is None:
            return pairs
        p, q = (sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        return pairs.join(p, "a").join(q, "b").where(alike(F.col("sketch_a"), F.col("sketch_b"))).select(*pairs.columns)

    # lists of one family share a centre: that which most of a list's members meet as the heaviest of all their lists
    long = state.where(F.col("n") > few)
    best = long.groupBy("id").agg(F.max("top")["id"].alias("best"))
    centre = long.join(best, "id").groupBy("key").agg(F.mode("best", True).alias("centre"))
    star = long.join(centre, "key").where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b"), F.lit(1).alias("star"))
    own = state.where(F.col("n") > PAIRS).where(F.col("id") != F.col("top.id")).select(F.col("id").alias("a"), F.col("top.id").alias("b"), F.lit(0).alias("star"))
    pairs = keep(short.union(star).union(sieved(own.distinct())).groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")
    wait = keep(state.where(F.col("n").between(PAIRS + 1, few)).select("key", "id", "weight", "size"), "middle")
    drop(state)
    return pairs, wait


def compared(pairs: DataFrame, texts: DataFrame, shingles: Shingler, percent: int) -> DataFrame:
    """(a, b, star, near, size, delta): near if the full sets are similar enough; a's size and delta for a star."""
    one = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "star", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, np.zeros(0, np.uint64)
        for b in batches:
            star = b.column(2).to_pylist()
            at = 0
            near, size, delta, held = [], [], [], 0
            for i in range(b.num_rows):
                s, t = b.column(3)[i].as_py(), b.column(4)[i].as_py()
                x = shingles(s)
                if t != last:
                    last, y = t, shingles(t)
                here = np.searchsorted(y, x)
                hit = here < len(y)
                hit[hit] = y[here[hit]] == x[hit]
                k = int(hit.sum())
                near.append(100 * k >= percent * (len(x) + len(y) - k))
                size.append(len(x))
                d = None
                if star[i]:
                    lost = np.ones(len(y), bool)
                    lost[here[hit]] = False
                    d = np.concatenate([x[~hit] * IN ^ IN, y[lost] * OUT ^ OUT]).view(np.int64)
                    held += len(d)
                delta.append(d)
                if held > 500_000 or i == b.num_rows - 1:
                    own = [b.column(k).slice(at, len(near)) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array(near), pa.array(size, pa.int64()), pa.array(delta, pa.list_(pa.int64()))],
                        names=["a", "b", "star", "near", "size", "delta"],
                    )
                    at, near, size, delta, held = i + 1, [], [], [], 0

    return both.mapInArrow(run, "a long, b long, star int, near boolean, size long, delta array<long>")


def flat(delta: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of all elements of a column of lists."""
    one = delta.combine_chunks()
    return np.repeat(np.arange(len(one)), one.value_lengths().to_numpy()), one.flatten().to_numpy()


def shared(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int, m: int, wide: int = 1024) -> np.ndarray:
    """How many elements each of n rows on the left shares with each of m rows on the right."""
    known, of = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
    x, y = of[: len(left[1])], of[len(left[1]) :]
    nx, ny = np.bincount(x, minlength=len(known)), np.bincount(y, minlength=len(known))
    out = np.zeros((n, m), np.float32)
    # rare elements: every holder on the left meets every one on the right
    rare = (nx > 0) & (ny > 0) & (nx * ny <= SPARSE)
    order = np.argsort(y, kind="stable")
    first, held = np.cumsum(ny) - ny, right[0][order]
    at = np.flatnonzero(rare[x])
    for s in range(0, len(at), SPARSE):
        i = at[s : s + SPARSE]
        count = ny[x[i]]
        j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first[x[i]], count)
        np.add.at(out, (np.repeat(left[0][i], count), held[j]), 1)
    # the others: products of zeros and ones, ``wide`` elements at a time
    many = np.flatnonzero((nx * ny) > SPARSE)
    column = np.full(len(known), -1)
    column[many] = np.arange(len(many))
    sides = []
    for rows, c in ((left[0], column[x]), (right[0], column[y])):
        use = np.flatnonzero(c >= 0)
        use = use[np.argsort(c[use], kind="stable")]
        sides.append((rows[use], c[use]))
    for s in range(0, len(many), wide):
        block = []
        for (rows, c), size in zip(sides, (n, m)):
            lo, hi = np.searchsorted(c, [s, s + wide])
            one = np.zeros((size, min(wide, len(many) - s)), np.float32)
            one[rows[lo:hi], c[lo:hi] - s] = 1
            block.append(one)
        out += block[0] @ block[1].T
    return out


def meeting(t: pa.Table, up: int) -> pa.Table:
    """(a, b): roots that get connected by links between the left (side 0) and right (1) of a meeting; 2 is both."""
    side = t["side"].to_numpy()
    at = [np.flatnonzero(side != 1), np.flatnonzero(side != 0)]
    known, label = np.unique(t["root"].to_numpy(), return_inverse=True)
    e, got = t["e"].to_numpy(), []
    if len(known) > 1 and all(map(len, at)):
        k = shared(*(flat(t["delta"].take(pa.array(i))) for i in at), *map(len, at))
        now, right = np.arange(len(known)), label[at[1]]
        for i, row in zip(at[0], k):
            near = 2 * up * row.astype(np.int64) >= e[i] + e[at[1]]
            mine = now[label[i]]
            for other in np.unique(now[right[near]]):
                if other != mine:
                    got.append((known[mine], known[other]))
                    now[now == other] = mine
    a, b = np.array(got, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _met(seen: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): links among the members of stars that connect different roots, by their deltas."""
    up, down = 100 + percent, 100 - percent
    star = seen.where("star = 1").select(F.col("a").alias("id"), "b", "size", "delta")
    for c, name in (("id", "root"), ("b", "centre")):
        star = star.join(roots.select(F.col("node").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    # sizes of two members that are similar lie in the same class or in neighbouring ones
    step = 1.0001 * max(math.log(100 / percent), 0.01)
    star = star.select("id", "b", "root", (F.col("root") == F.col("centre")).alias("inner"), F.floor(F.log("size") / step).alias("class"),
                       (up * F.size("delta") - down * F.col("size")).alias("e"), "delta")
    open_ = star.groupBy("b").agg(F.min("inner").alias("all")).where("not all").select("b")
    star = keep(star.join(open_, "b"), "members")
    part = ["b", "class", "inner"]
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / MEMBERS, F.sum(F.size("delta").cast("long")) / ELEMENTS))
    held = F.sum(F.size("delta").cast("long") + 8).alias("held")
    parts = keep(star.groupBy(*part).agg(F.greatest(F.lit(1), blocks.cast("int")).alias("blocks"), held), "parts")
    block = parts.select(*part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    one = block.select("b", F.struct("class", "inner", "block").alias("left"), F.explode(F.array("class", F.col("class") + 1)).alias("class"))
    two = block.select("b", "class", F.struct("class", "inner", "block").alias("right"))
    meet = one.join(two, ["b", "class"]).where("left <= right and not (left.inner and right.inner)").select("b", "left", "right")
    sides = meet.select("*", F.col("left").alias("at"), F.when(F.col("left") == F.col("right"), 2).otherwise(0).alias("side"))
    sides = sides.union(meet.where("left <> right").select("*", F.col("right").alias("at"), F.lit(1).alias("side")))
    sides = sides.select("b", "left", "right", "at.*", "side")
    volume = sides.join(parts, part).agg(F.sum(F.col("held") / F.col("blocks"))).first()[0] or 0
    most = max(SENT * (parts.agg(F.sum("held")).first()[0] or 0), SENT_LEAST)
    rounds = max(1, math.ceil(volume / most))
    dealt = star.join(parts.drop("held"), part).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = []
    for r in range(rounds):
        now = sides.where(F.pmod(F.xxhash64("b", "left", "right"), F.lit(rounds)) == r)
        sent = dealt.join(now, [*part, "block"]).select("b", "left", "right", "root", "e", "delta", "side")
        met.append(keep(sent.groupBy("b", "left", "right").applyInArrow(lambda t: meeting(t, up), "a long, b long"), "met"))
    drop(star, parts)
    if rounds == 1:
        return met[0]
    out = keep(reduce(DataFrame.union, met), "met")
    drop(*met)
    return out


def links(
    lists: DataFrame, texts: Callable[[DataFrame], DataFrame], shingles: Shingler, percent: int,
    few: int = FEW, sketches: DataFrame | None = None, alike: Alike | None = None,
) -> DataFrame | None:
    """Roots (node, root) of the members of ``lists`` (key, id, weight, size) that have links.

    ``size`` is that of a member's set, or 0 for all. ``texts`` gives (id, text) for a table of ids; ``shingles`` the sorted distinct elements of a text;
    ``sketches`` has (id, sketch) of each member; pairs whose sketches are not ``alike`` are not looked at, but for stars.
    """

    def joined(roots: DataFrame | None, new: DataFrame) -> DataFrame:
        out = components(new if roots is None else new.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        drop(roots, new)
        return out

    up = 100 + percent
    pairs, wait = _pairs(lists, None, few, up, sketches, alike)
    drop(lists)
    if pairs.isEmpty():
        drop(pairs, wait)
        return None
    # the second step only meets members of lists that wait
    ends = [pairs.select(F.col(c).alias("id")) for c in "ab"] + [wait.select("id")]
    held = keep(texts(reduce(DataFrame.union, ends).distinct()), "texts")
    seen = keep(compared(pairs, held, shingles, percent), "seen")
    drop(pairs)
    roots = joined(None, seen.where("near").select("a", "b"))
    roots = joined(roots, _met(seen, roots, percent))
    drop(seen)
    pairs, _ = _pairs(wait, roots, few, up, sketches, alike)
    drop(wait)
    seen = keep(compared(pairs, held, shingles, percent), "seen")
    drop(pairs, held)
    roots = joined(roots, seen.where("near").select("a", "b"))
    drop(seen)
    return roots
