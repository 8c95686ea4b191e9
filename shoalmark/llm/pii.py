"""Personal data by fixed shapes and bootstrapped contexts (operator 2).

Fixed shapes (email, ip, card, phone) are the seed entities. Each seed induces a lexical pattern, the two
words before it. Other identifier-like strings (seven or more digits with single separators, and
addresses with a spelled-out at sign) are unlabelled instances of the patterns they stand behind. Spark
scores the bipartite graph of patterns and instances in ``rounds``: a pattern's score for a kind is the
mean confidence of its distinct instances (plus one doubtful instance); an instance's confidence is that
some pattern of it is right, 1 - prod(1 - score). Seeds keep confidence 1. Patterns with enough distinct
seeds and a high score then mark the unlabelled strings behind them, as does a string whose digits are
those of a seed.

Every sum over a pattern is pre-aggregated before the shuffle, so frequent contexts are one row each.

Defined results: null and empty texts hold nothing; an empty table gives no rows; rows that repeat doc_id
and text share their result; spans of different kinds may overlap; equal starts are listed by kind. Texts
are read whole and in linear time. Ties: of two kinds for one string the better score wins, then the smaller
kind; columns other than doc_id and text are not read (``redact`` returns them as they are, whatever their names).
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, keep, table

KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
AT = re.compile(r"\x20?[\[(](?:at|AT)[\])]\x20?(?=[A-Za-z0-9])")
NOT_DIGIT, DIGIT, NOT_SPACE, WORD = (re.compile(x) for x in (r"[^0-9]", r"[0-9]", r"[^ ]+", r"\S+"))
MIN_DIGITS = 7
ROUNDS, MIN_SEEDS, MIN_SCORE = 3, 5, 0.8


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Grown from each at sign: the leftmost start is the run of local characters before it."""
    out, done, at = [], 0, t.find("@")
    while at >= 0:
        m = DOMAIN.match(t, at + 1)
        if m:
            s = at
            while s > done and t[s - 1] in LOCAL:
                s -= 1
            if s < at:
                out.append((s, m.end()))
                done = m.end()
        at = t.find("@", max(at + 1, done))
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed shapes, by start and kind."""
    out = [(s, 0, e) for s, e in emails(t)]
    for m in IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 12:
            d = NOT_DIGIT.sub("", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def identifiers(run: str, at: int) -> list[tuple[int, int]]:
    """A run of digits with separators is one identifier up to 40 characters; a longer one lists several.

    It is cut at its spaces; neighbours are joined until they hold MIN_DIGITS digits, and what is left at the end
    goes to the last one. A run without spaces stays whole, whatever its length.
    """
    if len(run) <= 40 or " " not in run:
        return [(at, at + len(run))]
    out, first, digits = [], None, 0
    for m in NOT_SPACE.finditer(run):
        first = m.start() if first is None else first
        digits += sum(map(str.isdigit, m.group()))
        end = m.end()
        if digits >= MIN_DIGITS:
            out.append((at + first, at + end))
            first, digits = None, 0
    if first is not None:
        out[-1:] = [(out[-1][0], at + end)]
    return out


def loose_spans(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, shape, end) of identifier-like strings beside the base: shape 0 address, 1 digits."""
    out = []
    for m in AT.finditer(t):
        s, e = m.start(), DOMAIN.match(t, m.end())
        while s and t[s - 1] in LOCAL:  # a sign ends each run, so no place is read twice
            s -= 1
        if s < m.start() and e:
            out.append((s, 0, e.end()))
    for m in LOOSE.finditer(t):
        out += [(s, 1, e) for s, e in identifiers(m.group(), m.start())]
    taken, free, k = [(s, e) for s, _, e in base], [], 0
    far = 0
    for s, shape, e in sorted(out):
        while k < len(taken) and taken[k][0] < e:
            far = max(far, taken[k][1])
            k += 1
        if far <= s:
            free.append((s, shape, e))
    return free


class Contexts:
    """The two words before a place, lower-case, digits as 0, for places of one text in rising order.

    Words of over 64 characters stand as their length and a checksum. Each word is read once, and of the word that
    a place lies in only what the place before it has not read.
    """

    def __init__(self, t: str):
        self.t, self.words, self.starts, self.held = t, None, [], {}
        self.part = (-1, 0, 0)  # word, place, checksum up to it

    def word(self, i: int) -> str:
        w = self.held.get(i)
        if w is None:
            s, e = self.words[i]
            w = self.held[i] = self.name(self.t[s:e]) if e - s <= 64 else f"{e - s}:{zlib.crc32(self.plain(self.t[s:e]).encode())}"
        return w

    @staticmethod
    def plain(w: str) -> str:
        return DIGIT.sub("0", w.lower())

    name = plain

    def before(self, place: int) -> str:
        if self.words is None:
            self.words = [m.span() for m in WORD.finditer(self.t)]
            self.starts = [s for s, _ in self.words]
        i = bisect_left(self.starts, place)  # words that start before the place
        out = []
        if i and self.words[i - 1][1] >= place:
            i -= 1
            s = self.words[i][0]
            if place - s <= 64:
                out.append(self.plain(self.t[s:place]))
            else:
                w, at, crc = self.part if self.part[0] == i and self.part[1] <= place else (i, s, 0)
                crc = zlib.crc32(self.plain(self.t[at:place]).encode(), crc)
                self.part = (i, place, crc)
                out.append(f"{place - s}:{crc}")
        while i and len(out) < 2:
            i -= 1
            out.insert(0, self.word(i))
        return " ".join(out)


def value(s: str) -> str:
    return NOT_DIGIT.sub("", s) if "@" not in s and not AT.search(s) else AT.sub("@", s).lower()


SPAN = "struct<start:long,kind:int,end:long>"
SEEN = "struct<start:long,kind:int,end:long,pattern:string,value:string>"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, seeds, loose): spans with contexts and values; ``loose`` has a shape for its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds, loose = [], []
            for x in b.column(2):
                t = x.as_py() or ""
                base = base_spans(t)
                more = loose_spans(t, base)
                at = Contexts(t)
                before = {s: at.before(s) for s in sorted({s for s, _, _ in base} | {s for s, _, _ in more})}
                for out, got in ((seeds, base), (loose, more)):
                    out.append([dict(start=s, kind=k, end=e, pattern=before[s], value=value(t[s:e])) for s, k, e in got])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("pattern", pa.string()), ("value", pa.string())]))
            cols = [b.column(0), b.column(1), pa.array(seeds, kind), pa.array(loose, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "rid", "seeds", "loose"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    return docs.mapInArrow(run, f"doc_id long, rid long, seeds array<{SEEN}>, loose array<{SEEN}>")


def patterns(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """The confident (pattern, kind, score) of a corpus."""
    one = lambda c: found.select(F.explode(c).alias("x")).select("x.pattern", "x.kind", "x.value")
    seed = one("seeds").distinct().where("pattern <> ''")
    loose = one("loose").select("pattern", F.col("kind").alias("shape"), "value").distinct().where("pattern <> ''")
    # an address can only be an email, digits anything else; only kinds that a pattern has seeds of matter
    held = seed.select("pattern", "kind").distinct()
    own = loose.join(held, "pattern").where((F.col("shape") == 0) == (F.col("kind") == 0)).drop("shape")
    edges = keep(seed.withColumn("seed", F.lit(1)).unionByName(own.withColumn("seed", F.lit(0))).groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")), "edges")
    sure = edges.where("seed = 1").select("kind", "value").distinct().withColumn("c", F.lit(1.0))
    belief = sure
    for i in range(rounds):
        score = edges.join(belief, ["kind", "value"], "left").groupBy("pattern", "kind").agg(
            (F.sum(F.coalesce("c", F.lit(0.0))) / (F.count(F.lit(1)) + 1)).alias("score"), F.sum("seed").alias("seeds")
        )
        score = keep(score, "patterns")
        if i < rounds - 1:
            no = F.log1p(-F.least("score", F.lit(1 - 1e-9)))
            belief = edges.join(score.select("pattern", "kind", "score"), ["pattern", "kind"]).groupBy("kind", "value").agg(
                F.greatest(1 - F.exp(F.sum(no)), F.max("seed").cast("double")).alias("c")
            )
    return score.where((F.col("seeds") >= min_seeds) & (F.col("score") >= min_score)).select("pattern", "kind", "score")


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, seeds, base, more) for every row: spans by fixed shapes and by contexts."""
    found = keep(find(docs), "found")
    good = keep(patterns(found), "good")
    loose = found.select("doc_id", "rid", F.explode("loose").alias("x")).distinct()
    loose = loose.select("doc_id", "rid", "x.*").withColumnRenamed("kind", "shape")
    fit = (F.col("shape") == 0) == (F.col("kind") == 0)
    by_pattern = loose.join(good, "pattern").where(fit).select("doc_id", "rid", "start", "end", "kind", "score")
    known = found.select(F.explode("seeds").alias("x")).select("x.kind", "x.value").distinct()
    by_value = loose.join(known, "value").where(fit).select("doc_id", "rid", "start", "end", "kind", F.lit(1.0).alias("score"))
    best = by_pattern.union(by_value).groupBy("doc_id", "rid", "start", "end").agg(F.max(F.struct("score", -F.col("kind"))).alias("b"))
    best = best.select("doc_id", "rid", F.struct("start", (-F.col("b")["col2"]).cast("int").alias("kind"), "end").alias("s"))
    more = best.groupBy("doc_id", "rid").agg(F.collect_list("s").alias("more")).select(F.col("doc_id").alias("of"), F.col("rid").alias("r"), "more")
    out = found.join(more, (F.col("rid") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    base = F.transform("seeds", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return out.select("doc_id", "rid", base.alias("base"), F.coalesce("more", F.slice(base, 1, 0)).alias("more"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind, as <EMAIL>; overlapping spans become one."""
    of, own, rid, found = (fresh(docs.columns, c) for c in ("of_doc", "own_rid", "rid", "found_spans"))
    spans = extract(docs).select(F.col("doc_id").alias(of), F.col("rid").alias(own), F.array_sort(F.concat("base", "more")).alias(found))
    spans = spans.where(F.size(found) > 0).dropDuplicates([of, own])
    df = docs.withColumn(rid, F.xxhash64("doc_id", "text"))
    df = df.join(spans, (F.col(rid) == F.col(own)) & F.col("doc_id").eqNullSafe(F.col(of)), "left").select(*docs.columns, found)
    names = docs.columns
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x, spans in zip(b.column(at), b.column(b.num_columns - 1)):
                t, got = x.as_py(), spans.as_py()
                if got:
                    out, done = [], 0
                    for s in got:
                        if s["start"] >= done:
                            out += [t[done : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                        done = max(done, s["end"])
                    t = "".join([*out, t[done:]])
                texts.append(t)
            cols = list(b.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            if length is not None:
                cols[length] = pa.array([None if t is None else len(t) for t in texts], cols[length].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, docs.schema)


def of_kind(kind: int):
    return lambda s: s["kind"] == kind


def op2_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))

    def listed(arr):
        return F.concat_ws(",", F.transform(F.array_sort(arr), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])))

    number = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select("doc_id", *number, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "more")).alias("spans"))
