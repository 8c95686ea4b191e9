"""Language-model scores by a subword lattice (operator 10).

The vocabulary of a public tokenizer gives pieces and scores. A text is a sequence of words, each written
with a leading word mark, and its probability is the sum over all ways to cut the words into pieces of the
product of the piece probabilities, times that of the end. As no piece goes across words, the sum is the
product of each word's own sum, found by a log-space forward recursion over its lattice.

Piece probabilities start from the vocabulary's scores (ranks r, read as 1 / (r + 10)) and are estimated
anew by ``steps`` rounds of expected counts over all distinct training words (forward-backward), smoothed
with the start. A character outside the vocabulary is spelled by the byte pieces.

Counts of words come from the whole corpus. A word's terms reach its documents in two ways: words that
are frequent enough to be among at most ``hot``, whatever their length, go to the workers as one table of at most
HOT_BYTES, all others are joined by word, where no key is frequent.

Defined results: null text is empty and scores its end alone; an empty table gives no rows; repeated rows
are scored each and counted each; a null doc_id counts as the empty text for the fold, so it trains.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

VOCABULARY = "piece_bpe_32k.model"
HOT, HOT_BYTES, WIDE, PIECE = 400_000, 32 << 20, 40, 4096
LN10 = math.log(10)


class Lattice:
    """Pieces in a character tree and the log-space recursions over words in batches."""

    def __init__(self, path: str | None):
        import public_tokenizers as P
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or P.path(VOCABULARY))
        n = sp.get_piece_size()
        self.size = n
        self.tree: dict = {}
        self.single: set[str] = set()
        prior = np.zeros(n)
        self.byte = [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                prior[i] = 1 / (n + 10)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or "▁" in piece[1:]):
                node = self.tree
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = i
                prior[i] = 1 / (10 - min(0.0, sp.get_score(i)))
                if len(piece) == 1:
                    self.single.add(piece)
        self.prior = prior / prior.sum()

    def edges(self, word: str, begin: int = 0, stop: int | None = None) -> list[tuple[int, int, list[int]]]:
        """(from, to, ids) of the lattice of a marked word, those from ``begin`` up to ``stop``; ids are several only where a character is spelled."""
        out, n, tree, single = [], len(word), self.tree, self.single
        for i in range(begin, n if stop is None else min(n, stop)):
            node = tree
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                x = node.get("")
                if x is not None:
                    out.append((i, j + 1, [x]))
            if word[i] not in single:
                out.append((i, i + 1, [self.byte[b] for b in word[i].encode()]))
        return out

    def long(self, word: str, lp: np.ndarray, weight: float = 0.0, into: np.ndarray | None = None) -> float:
        """The log probability of one word of any length; expected counts times ``weight`` are added to ``into``.

        Edges are made anew for PIECE characters at a time, so memory holds two numbers a character and one piece.
        """
        n = len(word)
        alpha = array("d", [-math.inf]) * (n + 1)
        alpha[0] = 0.0
        for s in range(0, n, PIECE):
            for i, j, ids in self.edges(word, s, s + PIECE):
                a, b = alpha[j], alpha[i] + sum(lp[x] for x in ids)
                m = max(a, b)
                if m > -math.inf:
                    alpha[j] = m + math.log(math.exp(a - m) + math.exp(b - m))
        if into is None:
            return alpha[n]
        beta = array("d", [-math.inf]) * (n + 1)
        beta[n] = 0.0
        for s in range((n - 1) // PIECE * PIECE, -1, -PIECE):
            for i, j, ids in reversed(self.edges(word, s, s + PIECE)):
                a, b = beta[i], beta[j] + sum(lp[x] for x in ids)
                m = max(a, b)
                if m > -math.inf:
                    beta[i] = m + math.log(math.exp(a - m) + math.exp(b - m))
                    w = weight * math.exp(alpha[i] + b - alpha[n])
                    for x in ids:
                        into[x] += w
        return alpha[n]

    def batch(self, words: list[str], lp: np.ndarray, weights: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of words; with ``weights``, expected piece counts are added to ``into``."""
        marked = ["▁" + w for w in words]
        out = np.empty(len(words))
        short = [k for k, w in enumerate(marked) if len(w) <= WIDE]
        for k, w in enumerate(marked):
            if len(w) > WIDE:
                out[k] = self.long(w, lp, 0.0 if weights is None else weights[k], into)
        if not short:
            return out
        short.sort(key=lambda k: len(marked[k]))
        for s in range(0, len(short), 1024):
            part = short[s : s + 1024]
            own = [marked[k] for k in part]
            n = np.array([len(w) for w in own])
            width = int(n.max())
            row, start, end, ids, more = [], [], [], [], {}
            for r, w in enumerate(own):
                for i, j, x in self.edges(w):
                    if len(x) > 1:
                        more[len(row)] = x
                    row.append(r)
                    start.append(i)
                    end.append(j)
                    ids.append(x[0])
            row, start, end, ids = (np.array(x) for x in (row, start, end, ids))
            cost = lp[ids]
            for e, x in more.items():
                cost[e] = sum(lp[y] for y in x)
            span = int((end - start).max())
            grid = np.full((width + 1, len(own), span + 1), -np.inf)
            # a spelled-out and a whole single character can share a cell only if the set held both; it never does
            grid[end, row, end - start] = cost
            alpha = np.full((width + 1, len(own)), -np.inf)
            alpha[0] = 0
            with np.errstate(invalid="ignore", divide="ignore"):
                for j in range(1, width + 1):
                    lens = np.arange(1, min(span, j) + 1)
                    x = alpha[j - lens].T + grid[j][:, lens]
                    m = x.max(1)
                    safe = np.where(np.isfinite(m), m, 0)
                    alpha[j] = np.log(np.exp(x - safe[:, None]).sum(1)) + safe
            total = alpha[n, np.arange(len(own))]
            out[part] = total
            if into is not None:
                beta = np.full((width + 1, len(own)), -np.inf)
                beta[n, np.arange(len(own))] = 0
                with np.errstate(invalid="ignore", divide="ignore"):
                    for i in range(width - 1, -1, -1):
                        lens = np.arange(1, min(span, width - i) + 1)
                        x = beta[i + lens].T + grid[i + lens, :, lens].T
                        m = x.max(1)
                        safe = np.where(np.isfinite(m), m, 0)
                        got = np.log(np.exp(x - safe[:, None]).sum(1)) + safe
                        beta[i] = np.logaddexp(beta[i], got)
                w = np.exp(alpha[start, row] + cost + beta[end, row] - total[row]) * weights[np.array(part)][row]
                np.add.at(into, ids, w)
                for e, x in more.items():
                    for y in x[1:]:
                        into[y] += w[e]
        return out


@lru_cache(maxsize=2)
def lattice(path: str | None) -> Lattice:
    return Lattice(path)


def _fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(word, c_train, c_all) over whole texts; workers add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            w = list(sums[0].keys() | sums[1].keys())
            cols = [pa.array([c[x] for x in w], pa.int64()) for c in sums]
            rec = pa.RecordBatch.from_arrays(
                [pa.array([x.decode() for x in w], pa.string()), *cols], names=["word", "c_train", "c_held"]
            )
            for c in sums:
                c.clear()
            return rec

        for b in batches:
            for held, t in zip(b.column(0).to_pylist(), b.column(1)):
                sums[bool(held)].update(words_of(t.as_py()))
                if len(sums[0]) + len(sums[1]) > flush:
                    yield rows()
        if sums[0] or sums[1]:
            yield rows()

    got = docs.select(_fold().alias("held"), "text").mapInArrow(run, "word string, c_train long, c_held long")
    return got.groupBy("word").agg(
        F.sum("c_train").alias("c_train"), (F.sum("c_train") + F.sum("c_held")).alias("c_all")
    )


def piece_counts(words: DataFrame, lp: np.ndarray, path: str | None) -> np.ndarray:
    """Expected counts of the pieces over the training words; a vector of the vocabulary's size."""
    shared = words.sparkSession.sparkContext.broadcast(lp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, into = lattice(path), np.zeros(len(shared.value))
        for b in batches:
            lat.batch(b.column(0).to_pylist(), shared.value, b.column(1).to_numpy().astype(float), into)
        ids = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(into[ids])], names=["id", "n"])

    got = words.where("c_train > 0").select("word", "c_train").mapInArrow(run, "id long, n double")
    out = np.zeros(len(lp))
    for i, n in got.groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def score(docs: DataFrame, steps: int = 1, hot: int = HOT, path: str | None = None) -> DataFrame:
    """Every row's doc_id, fold, token counts and scores (log10)."""
    spark = docs.sparkSession
    words = keep(word_counts(docs), "words")
    n_words, n_distinct = words.agg(F.sum("c_train"), F.count(F.when(F.col("c_train") > 0, 1))).first()
    ends = docs.where(~_fold()).count()
    big_n, big_v = (n_words or 0) + ends, n_distinct + (ends > 0)
    lat = lattice(path)
    p = lat.prior
    pieces = 0.0
    for _ in range(steps):
        with np.errstate(divide="ignore"):
            got = piece_counts(words, np.log(p), path)
        pieces = got.sum()
        p = (got + 100 * lat.prior) / (pieces + 100)
    # the end is one more symbol beside the pieces
    p_end = (ends + 1) / (ends + pieces + 2)
    with np.errstate(divide="ignore"):
        lp = spark.sparkContext.broadcast(np.log(p * (1 - p_end)))
    base_of = lambda c: math.log10((c + 1) / (big_n + big_v + 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = lattice(path).batch(b.column(0).to_pylist(), lp.value) / LN10
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=["word", "c_train", "c_all", "lp"])

    known = keep(words.mapInArrow(weigh, "word string, c_train long, c_all long, lp double"), "known")

    # the lowest count at which at most ``hot`` words of HOT_BYTES together remain: counts in bins of an eighth of a doubling
    level = F.floor(F.log2("c_all") * 8).cast("int")
    bins = known.groupBy(level.alias("l")).agg(F.count(F.lit(1)), F.sum(F.octet_length("word"))).collect()
    total, size, cut = 0, 0, math.inf
    for b, n, length in sorted(map(tuple, bins), reverse=True):
        total, size = total + n, size + length
        if total > hot or size > HOT_BYTES:
            break
        cut = b
    top = known.where(level >= F.lit(cut)).select("word", "c_train", "lp").toArrow() if cut < math.inf else None
    sent = spark.sparkContext.broadcast(None if top is None else [c.to_pylist() if k == 0 else c.to_numpy() for k, c in enumerate(top.columns)])
    held_terms: dict = {}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = held_terms.get("t")
        if table_ is None:
            v = sent.value
            table_ = {}
            if v is not None:
                base = np.log10((v[1] + 1) / (big_n + big_v + 1))
                table_ = {w.encode(): x for w, *x in zip(v[0], base.tolist(), v[2].tolist(), (v[1] > 0).tolist())}
            held_terms["t"] = table_
        get, row = table_.get, TaskContext.get().partitionId() << 33
        for b in batches:
            for k in range(0, b.num_rows, 512):
                x = b.slice(k, 512)
                cols: list[list] = [[] for _ in range(7)]
                for t in x.column(2):
                    w = words_of(t.as_py())
                    base = lpw = 0.0
                    seen, rest_w, rest_n = 0, [], []
                    for word, c in Counter(w).items():
                        e = get(word)
                        if e is None:
                            rest_w.append(word.decode())
                            rest_n.append(c)
                        else:
                            base += c * e[0]
                            lpw += c * e[1]
                            seen += c * e[2]
                    for col, v in zip(cols, (row, len(w) + 1, seen, base, lpw, rest_w, rest_n)):
                        col.append(v)
                    row += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*x.columns[:2], *(pa.array(c, t) for c, t in zip(cols, kinds))],
                    names=["doc_id", "held_out", "row", "n_tokens", "seen", "base", "lp", "rest", "times"],
                )

    schema = "doc_id long, held_out boolean, row long, n_tokens long, seen long, base double, lp double, rest array<string>, times array<long>"
    heads = keep(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fold().alias("held_out"), "text").mapInArrow(first, schema),
        "heads",
    )
    tail = heads.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x"))
    tail = tail.select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("c"))
    rare = known.select("word", "c_train", F.col("lp").alias("word_lp"))
    sums = tail.join(rare, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c_train") > 0, F.col("c")).otherwise(0)).alias("seen_"),
        F.sum(F.col("c") * F.log10((F.col("c_train") + 1) / F.lit(float(big_n + big_v + 1)))).alias("base_"),
        F.sum(F.col("c") * F.col("word_lp")).alias("lp_"),
    )
    out = heads.drop("rest", "times").join(sums, "row", "left")
    plus = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_"), F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (plus("seen") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(big_n).cast("long").alias("train_tokens"),
        (plus("base") + F.lit(base_of(ends))).alias("base_score"),
        (plus("lp") + F.lit(math.log10(p_end))).alias("score"),
    )


def op10_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
