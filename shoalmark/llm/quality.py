"""Quality rules judged by an isolation forest on rule statistics (operator 9).

Each document gets rule statistics (length, symbols, repeated lines and windows, word shapes). A forest of
random-split trees is grown on a sample of labelled clean rows of at most ``trees * psi`` rows, in order
of a hash of the doc_id; short expected path lengths mean an unusual document. The threshold is
calibrated on all labelled rows that pass the base rule, as only of these the forest decides: the lowest score at
which at most ``clean_loss`` of the rows labelled clean (quality 1, not toxic) would go, moved up to where the
gain in bad rows is largest.

Defined results: a null or word-less text has no words and fails the base rule; without labels of both
kinds nothing but the base rule rejects; ties in score share a verdict; repeated rows are judged each;
rows of a null doc_id are judged too, and an empty table gives no rows. Very long texts are read whole;
other columns are not read (``keep_good`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
TREES, PSI, DEPTH, CLEAN_LOSS = 100, 256, 8, 0.005
STATS = 11


def repeats(ids: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n].copy()
    for k in range(1, width):
        # number the distinct prefixes, so that keys stay below n * n whatever the vocabulary
        key = np.unique(key, return_inverse=True)[1] * (int(ids.max()) + 1) + ids[k : k + n]
    _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(cnt[inv] >= 2)
    cover = np.zeros(len(ids), bool)
    for k in range(width):
        cover[hit + k] = True
    return int(cover.sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the statistics that the forest sees."""
    t = text or ""
    words = t.encode().split()
    n = len(words)
    chars = len(t) - sum(map(t.count, SPACES))
    symbols = sum(map(t.count, SYMBOLS))
    lines = [x for x in t.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    if not n:
        return [0, chars, symbols, dup, 0], [0.0] * STATS
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    rep = repeats(ids)
    lens = np.fromiter(map(len, words), np.int64, n)
    stats = [
        np.log1p(n),
        chars / n,
        symbols / n,
        dup / max(1, len(lines)),
        rep / n,
        len(number) / n * np.log1p(n),
        float(np.bincount(ids).max()) / n,
        np.log1p(float(lens.max())),
        float(lens.std()),
        (t.count(".") + t.count(",")) / n,
        np.log1p(n / max(1, len(lines))),
    ]
    return [n, chars, symbols, dup, rep], [float(x) for x in stats]


class Forest:
    """Random-split trees in arrays; ``score`` is 2 ** (-mean path / c(psi)), higher = more unusual."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, psi: int = PSI, depth: int = DEPTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, size = depth, 2 ** (depth + 1) - 1
        self.feat = np.zeros((trees, size), np.int16)
        self.cut = np.full((trees, size), np.inf)
        self.path = np.zeros((trees, size))
        self.norm = self.c(min(psi, len(rows)))
        for t in range(trees):
            pick = rows[rng.choice(len(rows), min(psi, len(rows)), replace=False)]
            self._grow(t, 0, pick, 0, rng)

    @staticmethod
    def c(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, t: int, node: int, rows: np.ndarray, d: int, rng: np.random.Generator) -> None:
        wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if d == self.depth or not len(wide):
            # passing rows fall through to the left at infinite cuts; their path ends here
            self._fill(t, node, d, d + self.c(len(rows)))
            return
        f = rng.choice(wide)
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        self.feat[t, node], self.cut[t, node] = f, cut
        left = rows[:, f] <= cut
        self._grow(t, 2 * node + 1, rows[left], d + 1, rng)
        self._grow(t, 2 * node + 2, rows[~left], d + 1, rng)

    def _fill(self, t: int, node: int, d: int, path: float) -> None:
        for _ in range(d, self.depth):
            node = 2 * node + 1
        self.path[t, node] = path

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feat))
        node = np.zeros((len(x), len(trees)), np.int64)
        at = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[at, self.feat[trees, node]] > self.cut[trees, node])
        return 2.0 ** (-self.path[trees, node].mean(1) / max(self.norm, 1e-9))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, and ``stats`` (array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t.as_py()) for t in b.column(1)]
            counts = [pa.array([g[0][k] for g in got], pa.int64()) for k in range(len(COUNTS))]
            stats = pa.array([g[1] for g in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, stats], names=["doc_id", *COUNTS, "stats"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, stats array<double>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT * n_words


def fit(
    stats: DataFrame, labels: DataFrame, trees: int = TREES, psi: int = PSI, clean_loss: float = CLEAN_LOSS
) -> tuple[Forest | None, float]:
    """The forest and the score from which on a document is rejected (infinite: none)."""
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    one = one.agg(F.min(F.when(good, 1).otherwise(0)).alias("clean"))
    rows = keep(stats.where(~failed()).join(one, "doc_id").select("doc_id", "stats", "clean"), "labelled")
    sample = rows.where("clean = 1").orderBy(F.xxhash64("doc_id"), "doc_id", "stats").limit(trees * psi).select("stats")
    x = np.array([r[0] for r in sample.collect()], float)
    if len(x) < 2:
        return None, np.inf
    forest = Forest(x, trees, psi)
    hist = scored(rows, forest, ["clean"]).groupBy("clean", F.floor(F.col("score") * 2000).cast("int").alias("bin"))
    count = np.zeros((2, 2002))
    for clean, k, n in hist.count().collect():
        count[int(clean), int(k)] += n
    clean, bad = (count[k][::-1].cumsum()[::-1] for k in (1, 0))  # rows at or above each bin
    if not bad[0]:
        return forest, np.inf
    fit_ = np.flatnonzero(clean <= clean_loss * clean[0])
    gain = bad[fit_] / bad[0] - clean[fit_] / clean[0]
    best = fit_[np.argmax(gain)]
    return forest, float(best) / 2000 if gain.max() > 0 else np.inf


def scored(rows: DataFrame, forest: Forest, rest: list[str]) -> DataFrame:
    """``rest`` and score of rows that have ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(len(rest)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            got = np.concatenate([forest.score(x[k : k + 1024]) for k in range(0, len(x), 1024)]) if len(x) else x[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(got)], names=[*rest, "score"])

    schema = rows.select(*rest, F.lit(0.0).alias("score")).schema
    return rows.select(*rest, "stats").mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept, score of every row."""
    stats = keep(statistics(docs), "stats")
    forest, limit = fit(stats, labels)
    rest = ["doc_id", *COUNTS]
    out = scored(stats, forest, rest) if forest else stats.select(*rest, F.lit(0.0).alias("score"))
    return out.withColumn("base_failed", failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") < limit))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; texts are not shuffled but measured again."""
    forest, limit = fit(keep(statistics(docs), "stats"), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t.as_py()) for t in b.column(at)]
            ok = np.array([not base_failed(c[0], c[4]) for c, _ in got], bool)
            if forest and len(got):
                ok &= forest.score(np.array([s for _, s in got])) < limit
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def op9_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "score")
