"""Secrets in texts: fixed shapes and character Markov models (operator 3), in DataFrame functions only.

Base shapes are found by regular expressions; places come from splitting the text by the same expression,
so they are code points. Beyond them, tokens of 12 and more of letters, digits and +/_=- that hold a letter (digits
alone are numbers) are scored by two first-order character models, one of random strings and one of ordinary
identifiers: the sum of the logarithms of their transition ratios. Labelled samples train both: random
are ``samples`` generated strings in each of three alphabets and the values of the base finds, ordinary
are all long words without digits in the corpus. Tokens at or above ``bits`` are secrets of kind ``random``
unless they overlap a base find.
A secret of letters alone is itself counted as an ordinary word; in a corpus of a few hundred documents that is
enough to hide it. A token that overlaps a base find anywhere is left out whole.

Defined results: null and empty texts have no finds; an empty table gives no rows; repeated rows are
scanned each. Texts are scanned whole.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind, expression, the test of a match; the lengths are part of an expression where that finds the same
KINDS = [
    ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    ("access", r"AKIA[A-Z0-9]{16,}", None),
    ("hex", r"[0-9a-f]{24,}", None),
]
TOKEN, ORDINARY = r"[A-Za-z0-9+/_=-]{12,}", r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_-]{11,}"
BITS, SAMPLES, CODES, BACKOFF = 10.0, 2048, 128, 20.0


def running(parts: Column) -> Column:
    """array<struct<start, end, ok>> of matches from an array<struct<gap, len, ok>>, in blocks of about the root of their number.

    An array is copied whenever an element is put behind it, so one pass would take the square of the number.
    """
    none = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")

    def block(one: Column) -> Column:
        # matches of one block, from 0 on, and where the block ends
        def step(s: Column, x: Column) -> Column:
            start = s["at"] + x["gap"]
            new = F.array(F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["ok"].alias("ok")))
            return F.struct((start + x["len"]).alias("at"), F.concat(s["out"], new).alias("out"))

        return F.aggregate(one, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def shift(s: Column, x: Column) -> Column:
        return F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["from"], F.array(s["at"])).alias("from"))

    def whole(p: Column, size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda i: block(F.slice(p, i * size + 1, size)))
        first = lambda v: F.aggregate(v, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("from")), shift, lambda s: s["from"])
        moved = lambda x, d: F.transform(x["out"], lambda y: F.struct((y["start"] + d).alias("start"), (y["end"] + d).alias("end"), y["ok"].alias("ok")))
        return let(blocks, lambda v: F.flatten(F.zip_with(v, first(v), moved)))

    return let(parts, lambda p: let(F.ceil(F.sqrt(F.size(p))).cast("int"), lambda n: F.when(F.size(p) > 0, whole(p, n)).otherwise(none)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, found: Column, pattern: str, kind: int, test=None) -> Column:
    """array<struct<start, kind, end>> of the matches ``found`` of ``pattern`` in ``text``."""
    ok = (lambda m: F.lit(True)) if test is None else test
    one = lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), ok(m).alias("ok"))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, one)
    out = F.transform(F.filter(running(pairs), lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(F.size(found) > 0, out).otherwise(none)


def listed(arr: Column, names: list[str]) -> Column:
    """kind:start:end, by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, names))
    text = F.transform(F.array_sort(arr), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]))
    return F.concat_ws(",", text)


def transitions(strings: DataFrame) -> DataFrame:
    """(a, b, n): how often code b follows code a in the column ``s``; a is 0 at the start."""
    at = strings.select("s", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("i"))
    a = F.when(F.col("i") == 1, 0).otherwise(F.ascii(F.expr("substring(s, i - 1, 1)")))
    pairs = at.select(a.alias("a"), F.ascii(F.expr("substring(s, i, 1)")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def model(docs: DataFrame, samples: int = SAMPLES) -> list[float]:
    """For codes a, b at a * CODES + b the log2 ratio of random to ordinary."""
    spark = docs.sparkSession
    seeds = spark.range(samples)
    made = [
        F.sha2(F.concat(F.lit("hex"), "id").cast("binary"), 256),
        F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("mixed"), "id").cast("binary"), 256))), "=+$", ""),
        F.conv(F.substring(F.sha2(F.concat(F.lit("upper"), "id").cast("binary"), 256), 1, 15), 16, 36),
    ]
    random = seeds.select(F.explode(F.array(*made)).alias("s"))
    values = [F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(2 if k == "assign" else 0)), lambda v: F.regexp_replace(v, r"[^A-Za-z0-9+/_=-]", "")) for k, p, _ in KINDS]
    random = random.union(docs.select(F.explode(F.concat(*values)).alias("s")).where("length(s) >= 16"))
    ordinary = docs.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), 0)).alias("s"))
    counts = transitions(random).withColumn("kind", F.lit(1)).union(transitions(ordinary).withColumn("kind", F.lit(0)))
    n = {(kind, x, y): c for x, y, c, kind in counts.collect() if x < CODES and y < CODES}  # at most 2 * CODES^2 rows
    letters = [k for k in range(CODES) if re.fullmatch("[A-Za-z0-9+/_=-]", chr(k))]
    after, alone = Counter(), Counter()
    for (kind, x, y), c in n.items():
        after[kind, x] += c
        alone[kind, y] += c
    size = [sum(c for (kind, _), c in alone.items() if kind == k) for k in (0, 1)]
    llr = [0.0] * (CODES * CODES)
    for y in letters:
        one = [(alone[k, y] + 0.5) / (size[k] + 0.5 * len(letters)) for k in (0, 1)]
        for x in range(CODES):
            # transitions out of rare characters lean on the frequency of the next character alone
            p = [(n.get((k, x, y), 0) + BACKOFF * one[k]) / (after[k, x] + BACKOFF) for k in (0, 1)]
            llr[x * CODES + y] = round(math.log2(p[1] / p[0]), 9)
    return llr


def scan(docs: DataFrame, bits: float = BITS) -> DataFrame:
    """doc_id, base (array of spans of the fixed shapes) and more (of kind 3, random), for every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    llr = F.from_json(F.lit(json.dumps(model(docs))), "array<double>")
    df = docs.withColumns({k: F.regexp_extract_all("text", F.lit(p), 0) for k, p, _ in KINDS} | {"tok": F.regexp_extract_all("text", F.lit(TOKEN), 0)})
    parts = [spans(F.col("text"), F.col(k), p, i, t) for i, (k, p, t) in enumerate(KINDS)]
    df = df.withColumn("base", F.concat(*parts))
    worded = lambda m: m.rlike("[A-Za-z]")
    rest = spans(F.col("text"), F.col("tok"), TOKEN, 3, worded)
    some = F.exists("tok", worded)
    df = df.withColumn("cand", F.when(some, rest).otherwise(F.slice(F.col("base"), 1, 0)))
    clear = F.filter("cand", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    df = df.select("doc_id", "base", F.when(F.size("cand") > 0, F.transform(clear, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), F.substring("text", c["start"] + 1, c["end"] - c["start"]).alias("s")))).alias("cand"))

    def ratio(s: Column) -> Column:
        codes = F.transform(F.split(s, ""), F.ascii)
        add = lambda acc, b: F.struct((acc["v"] + F.get(llr, acc["a"] * CODES + b)).alias("v"), b.alias("a"))
        return F.aggregate(codes, F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("a")), add, lambda acc: acc["v"])

    good = F.transform(F.filter("cand", lambda c: ratio(c["s"]) >= bits), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return df.select("doc_id", "base", F.coalesce(good, F.slice("base", 1, 0)).alias("more"))


def of_kind(kind: int):
    return lambda s: s["kind"] == kind


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    names = [k for k, _, _ in KINDS] + ["random"]
    number = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{names[i]}") for i in range(3)]
    return got.select(
        "doc_id",
        *number,
        F.sha2(listed(F.col("base"), names), 256).alias("base_sha256"),
        listed(F.concat("base", "more"), names).alias("spans"),
        F.size("more").cast("long").alias("n_random"),
    )
