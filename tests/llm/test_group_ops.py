"""Search, duplicates, link graph and pipeline against brute force."""

import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from shoalmark.llm import common, line_dedup, linkgraph, minhash, simjoin, vptree

random.seed(5)
SF = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 140)} == {100} and got[201] == 200 and len(got) == 83
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_search_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(700)] + [(k, [1.0] * 8) for k in range(700, 900)]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, []), (1080, [None] * 8), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), shard=200, block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.array([v for _, v in rows])
    for q in range(0, 900, 20):
        s = vptree.dots(np.repeat(x[q : q + 1], len(x), 0), x)
        want = [int(k) for k in np.lexsort((np.arange(len(x)), -s)) if k != q][:20]
        assert [v for v, _ in got[q]] == want and [s_ for _, s_ in got[q]] == s[want].tolist()
    assert set(got) == set(range(0, 900, 20))
    loose = vptree.nearest(df, df.where("vec_id % 20 = 0"), shard=200, factor=1.3)
    hit = sum((r.vec_id in {v for v, _ in got[r.query_id]}) for r in loose.collect())
    assert hit >= 0.5 * sum(map(len, got.values()))
    assert vptree.nearest(df.where("false"), df.where("false")).count() == 0


def words(n):
    return [random.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(random.randint(0, 30)) for _ in range(n)]


def family(n, size, edits):
    base = words(n)
    for _ in range(size):
        w = list(base)
        for _ in range(edits):
            w[random.randrange(n)] = random.choice(words(1))
        yield " ".join(w)


def test_near_duplicates(spark):
    texts = [t for n, size, e in ((80, 30, 1), (60, 20, 3), (40, 12, 2), (12, 10, 1)) for t in family(n, size, e)]
    texts += [texts[0]] * 5 + [None, "", " \n", "one", "one", "ONE", "two words", " ".join(words(3000))]
    common_passage = " ".join(words(30))
    texts += [f"{' '.join(words(60))} {common_passage}" for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").repartition(4)
    for width in (2, 5):
        sets = [frozenset(minhash.shingles(t, width).tolist()) for t in texts]
        par = list(range(len(texts)))

        def find(k):
            while par[k] != k:
                k = par[k]
            return k

        for i, a in enumerate(sets):
            for j in range(i):
                k = len(a & sets[j])
                if a and sets[j] and 100 * k >= 80 * (len(a) + len(sets[j]) - k):
                    x, y = sorted((find(i), find(j)))
                    par[y] = x
        got = minhash.near_duplicates(d, width).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id)) and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(d.where("false")).count() == 0


def test_lines(spark):
    near = list(family(30, 8, 1))
    texts = ["\n".join(["shared boilerplate line here", near[k], f"own line {k} {' '.join(words(6))}", "", "  "]) for k in range(8)]
    texts += [texts[0], None, "", "\n\n", "shared boilerplate line here", "ab\nab\nxy"]
    d = spark.createDataFrame([(k, t, "en", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, gone string, n_chars long")
    out = {r.doc_id: r for r in line_dedup.dedup(d).collect()}
    assert out[0].text == texts[0] and 8 not in out and 12 not in out
    for k in range(1, 8):
        assert out[k].text == "\n".join(texts[k].split("\n")[2:]) and out[k].n_chars == len(out[k].text)
    assert out[9].text is None and out[10].text == "" and out[11].text == "\n\n" and out[13].text == "ab\nxy"
    assert line_dedup.dedup(d.where("false")).count() == 0


def brute_roots(sets, percent=80):
    par = list(range(len(sets)))

    def find(k):
        while par[k] != k:
            k = par[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if 100 * k >= percent * (len(a) + len(sets[j]) - k):
                x, y = sorted((find(i), find(j)))
                par[y] = x
    return [find(k) for k in range(len(sets))]


def test_stars_and_deltas_are_exact(spark):
    """A family whose members lie around the threshold from one another: every link between components is found."""
    rng = random.Random(4)
    core = [f"w{k}" for k in range(60)]
    rows = [list(core)]
    for k in range(300):
        w = list(core)
        for _ in range(rng.choice([1, 2, 4, 6, 7, 8, 9])):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append(w)
    sets = [frozenset(simjoin_words(r)) for r in rows]
    lists = spark.createDataFrame([(1, k, 1000 - k, 0, 0, 0) for k in range(len(rows))], "key long, id long, weight long, e long, k int, size long")
    texts = spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "id long, text string")
    for few in (8, 64, 1000):
        got = simjoin.links(lists, lambda ids: texts.join(ids, "id", "left_semi"), lambda t: minhash.shingles(t, 1), 80, few=few)
        root = {r.node: r.root for r in got.collect()}
        assert [root.get(k, k) for k in range(len(rows))] == brute_roots(sets)


@pytest.mark.parametrize("members, sparse", [(40, 10), (1024, 1000)])
def test_members_of_a_star_meet_as_deltas(spark, monkeypatch, members, sparse):
    """Long lists are settled by deltas in blocks: texts are compared once a member, however many lie at the threshold."""
    rng = random.Random(9)
    core = [f"w{k}" for k in range(60)]
    rows = [list(core)]
    for k in range(400):
        w = list(core) + [f"y{j}" for j in range(rng.choice([0, 0, 5, 12, 40]))]
        for _ in range(rng.choice([3, 6, 7, 8, 9, 12])):
            w[rng.randrange(60)] = f"x{rng.randrange(30)}"
        rows.append(w)
    lists = spark.createDataFrame([(1, k, 1000 - k, 0, 0, 0) for k in range(len(rows))], "key long, id long, weight long, e long, k int, size long")
    texts = spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "id long, text string")
    counts, compared = [], simjoin.compared

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(simjoin, "compared", counted)
    monkeypatch.setattr(simjoin, "MEMBERS", members, raising=False)
    monkeypatch.setattr(simjoin, "SPARSE", sparse, raising=False)
    got = simjoin.links(lists, lambda ids: texts.join(ids, "id", "left_semi"), lambda t: minhash.shingles(t, 1), 80)
    root = {r.node: r.root for r in got.collect()}
    want = brute_roots([frozenset(simjoin_words(r)) for r in rows])
    assert [root.get(k, k) for k in range(len(rows))] == want and 10 < len(set(want)) < 390
    assert sum(counts) <= 2 * len(rows)


def simjoin_words(words):
    return minhash.shingles(" ".join(words), 1).tolist()


def test_lines_equal_brute_force(spark):
    rng = random.Random(12)
    lines = []
    for size, n in ((14, 60), (6, 80), (40, 30)):
        base = words(size)
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(size)] = words(1)[0]
            lines.append(" ".join(w))
    lines += [" ".join(words(9)) for _ in range(60)] + ["ab", "abc", "ab", "", "  ", "-" * 300, "-" * 290, "x" * 20_000]
    rng.shuffle(lines)
    docs = [(k, "\n".join(lines[k * 6 : k * 6 + 6])) for k in range(-(-len(lines) // 6))]
    sets = [frozenset(line_dedup.shingles(x).tolist()) if x.strip() else frozenset([-1 - k]) for k, x in enumerate(lines)]
    root = brute_roots(sets)
    want = {k: [i for i in range(k * 6, min(len(lines), k * 6 + 6)) if root[i] == i] for k, _ in docs}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("RID", F.lit(1)).withColumn("gone_lines", F.lit(2))
    got = {r.doc_id: r for r in line_dedup.dedup(d).collect()}
    lost = 0
    for k, keep_ in want.items():
        mine = got[k].text.split("\n") if k in got else []
        lost += len(set(mine) ^ {lines[i] for i in keep_})
    assert lost <= 2  # a pair just at the threshold may be missed
    assert all(r.RID == 1 and r.gone_lines == 2 for r in got.values())


def test_families_of_lines_need_few_comparisons(spark, monkeypatch):
    """Lines around the threshold from one another, more than a short list holds: not all pairs are rows."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    core = [word() for _ in range(30)]
    lines = []
    for _ in range(500):
        w = list(core)
        for k in rng.sample(range(30), rng.choice([2, 3, 3, 4])):
            w[k] = word()
        lines.append(" ".join(w))
    counts, compared = [], simjoin.compared

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(simjoin, "compared", counted)
    docs = spark.createDataFrame([(k, "\n".join(lines[k * 10 : k * 10 + 10])) for k in range(50)], "doc_id long, text string")
    gone = {r.doc_id * 10 + p for r in line_dedup.dropped(docs).collect() for p in r.gone}
    want = brute_roots([frozenset(line_dedup.shingles(x).tolist()) for x in lines])
    assert len(gone ^ {k for k, r in enumerate(want) if r != k}) <= 2  # a pair just at the threshold may be missed
    assert sum(counts) <= 40 * len(lines)


def test_chance_meetings_of_lines_are_not_postings(spark, monkeypatch):
    """Unlike lines that share a band by chance grow with the square of the lines: they leave where keys are dealt."""
    rng = random.Random(31)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(3000):  # similarity about 0.33
        one = text(60)
        lines += [one + text(60), one + text(60)]
    unlike = len(lines)
    for _ in range(200):
        one = text(200)
        lines += [one, one[:100] + "-" + one[101:]]
    keys = line_dedup.bands(line_dedup.minima([x.encode() for x in lines[:unlike]]))
    meetings = int((keys[::2] == keys[1::2]).sum())
    held, links = [], simjoin.links

    def counted(lists, *rest, **more):
        held.append(lists.join(far, "id").count())
        return links(lists, *rest, **more)

    docs = spark.createDataFrame([(k, "\n".join(lines[k * 2 : k * 2 + 2])) for k in range(len(lines) // 2)], "doc_id long, text string")
    far = docs.where(F.col("doc_id") < unlike // 2).select(F.explode(F.split("text", "\n")).alias("text")).select(F.xxhash64("text").alias("id"))
    monkeypatch.setattr(simjoin, "links", counted)
    gone = {(r.doc_id, *r.gone) for r in line_dedup.dropped(docs).collect()}
    assert gone == {(k, 1) for k in range(unlike // 2, len(lines) // 2)}
    assert meetings > 30 and held[0] < meetings  # two postings a meeting if all stay


def test_chance_lists_of_many_lines_are_not_postings(spark, monkeypatch):
    """On larger tables unlike lines share a band by threes and more: these leave where keys are dealt, too."""
    rng = random.Random(37)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(100):  # similarity about 0.33
        one = text(60)
        lines += [one + text(60) for _ in range(40)]
    keys = line_dedup.bands(line_dedup.minima([x.encode() for x in lines]))
    n = np.concatenate([np.unique(k, return_counts=True)[1] for k in keys.T])
    held, links = [], simjoin.links

    def counted(lists, *rest, **more):
        held.append(lists.count())
        return links(lists, *rest, **more)

    monkeypatch.setattr(simjoin, "links", counted)
    docs = spark.createDataFrame([(k, "\n".join(lines[k * 40 : k * 40 + 40])) for k in range(100)], "doc_id long, text string")
    assert line_dedup.dropped(docs).count() == 0
    assert n[n > 2].sum() > 100 and 5 * held[0] < n[n > 2].sum()


def test_copies_of_a_line_do_not_meet_in_one_task(spark):
    """A line that many documents hold is fetched from one of them; its copies are not dealt to one task."""
    texts = [f"the common line of all\nown line {k}\nthe common line of all" for k in range(2000)]
    docs = spark.createDataFrame([*enumerate(texts), (2000, None), (None, "no id\nthe common line of all")], "doc_id long, text string")
    at = line_dedup.places(docs)
    want = ["the common line of all", "own line 7", "own line 8", "no id"]
    ids = spark.createDataFrame([(x,) for x in want], "text string").select(F.xxhash64("text").alias("id"))
    assert line_dedup.copies(docs, ids, at).count() <= 5  # one document holds the common line once or twice
    got = line_dedup.texts_of(docs, ids, at)
    assert sorted(r.text for r in got.collect()) == sorted(want) and got.select("id").distinct().count() == 4


def test_pipeline_run_keeps_the_last_stage_only(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same = lambda spark, docs, sf_dir: docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, same) for name in ("stage_one", "stage_two", "stage_three")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    root = common.scratch_root(spark).removeprefix("file:")
    assert [n.split("-")[0] for n in sorted(os.listdir(root)) if n.startswith("stage_")] == ["stage_three"]


def test_block_meetings_are_sent_in_rounds(spark, monkeypatch):
    """What is sent at once is bounded by the members, not by the square of a family; links are those of one round."""
    rng = random.Random(17)
    core = [f"w{k}" for k in range(60)]
    rows = [list(core)]
    for _ in range(300):
        w = list(core)
        for _ in range(rng.choice([3, 6, 7, 8, 9, 12])):
            w[rng.randrange(60)] = f"x{rng.randrange(30)}"
        rows.append(w)
    lists = spark.createDataFrame([(1, k, 1000 - k, 0) for k in range(len(rows))], "key long, id long, weight long, size long")
    texts = spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "id long, text string")
    names, keep = [], simjoin.keep
    monkeypatch.setattr(simjoin, "keep", lambda df, name: (names.append(name), keep(df, name))[1])
    for name, value in (("MEMBERS", 20), ("SENT", 2), ("SENT_LEAST", 1)):
        monkeypatch.setattr(simjoin, name, value, raising=False)
    got = simjoin.links(lists, lambda ids: texts.join(ids, "id", "left_semi"), lambda t: minhash.shingles(t, 1), 80)
    root = {r.node: r.root for r in got.collect()}
    assert [root.get(k, k) for k in range(len(rows))] == brute_roots([frozenset(simjoin_words(r)) for r in rows])
    assert names.count("met") > 2


def test_line_shingles_are_the_distinct_windows():
    rng = random.Random(5)
    letters = ["ab", "abcdefgh ", "aé\u0fff\u1000世", "世界\U0001f600", "a\U0010ffff"]
    lines = ["".join(rng.choice(x) for _ in range(n)) for x in letters for n in (1, 3, 5, 6, 40, 300)]
    of = [set(x[k : k + 5] for k in range(len(x) - 4)) or {x} for x in lines]
    got = [line_dedup.shingles(x) for x in lines]
    for a, x in zip(of, got):
        assert (np.sort(x) == x).all()
        for b, y in zip(of, got):
            assert (len(a), len(a & b)) == (len(x), len(np.intersect1d(x, y)))


def test_line_bands_see_all_shingles():
    rng = random.Random(8)

    def shingles(s):
        return {s[i : i + 5] for i in range(len(s) - 4)} if len(s) >= 5 else {s}

    for letters in ("abcdefghiklmnoprstuvwy", "abcdefghi klmnop rstuvwy", "世界日本語漢字àéîõü"):
        lines = []
        while len(lines) < 1600:
            a = "".join(rng.choice(letters) for _ in range(rng.choice([40, 100, 200])))
            b = list(a)
            for _ in range(rng.randint(1, 4)):
                b[rng.randrange(len(b))] = rng.choice(letters)
            x, y = shingles(a), shingles("".join(b))
            if 0.8 <= len(x & y) / len(x | y) <= 0.9:
                lines += [a, "".join(b)]
        k = line_dedup.bands(line_dedup.minima([x.encode() for x in lines]))
        assert (k[::2] == k[1::2]).any(1).mean() > 0.99
    short = ["ab", "abc", "ab", "abcde", "b", "abcdef", "ab"]
    keys = lambda lines: line_dedup.bands(line_dedup.minima([x.encode() for x in lines]))
    k = keys(short)
    assert (k[0] == k[2]).all() and (k[0] == k[6]).all() and not (k[0] == k[1]).any() and not (k[1] == k[3]).any()
    assert (keys(["ab"]) == k[0]).all() and (keys(["abcdef"]) == k[5]).all()


def test_urls(spark):
    urls = ["HTTP://News.Example.NET/en/1?x=/en/", "http://example.net", "http://sub.example.com/de/x#y", "http://Site.org/fr/", None, "no scheme", "a://", "ftp://x.org?/fr/", "http://notnet/", "http://net/q", "http://other.org/zz"]
    html = '<a href="http://good.site.org/fr/1">x</a>' * 3
    d = spark.createDataFrame([(k, u, html if k % 2 else None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linkgraph.judge(d).collect()}
    assert got[0] == ("news.example.net", "/en/1", "example.net/en/", "allow") and got[1] == ("example.net", "", None, got[1][3])
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4] == ("", "", None, "allow") and got[5][:2] == ("", "") and got[6][:2] == ("", "") and got[7][:2] == ("x.org", "")
    assert got[8][2] is None and got[9] == ("net", "/q", "net/", "block") and len(got) == len(urls)
    assert linkgraph.judge(d.where("false")).count() == 0


def test_parents_of_parents(spark):
    urls = ["http://www.theres.example.com/de/1", "http://a.b.example.com/q", "http://example.org/fr/"]
    d = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string")
    edges = {(r.src, r.dst) for r in linkgraph.links(linkgraph.with_rule(linkgraph.split_url(d))).collect()}
    assert {("theres.example.com", "example.com"), ("example.com", "b.example.com")} <= edges and len(edges) == 8
    got = {r.page_id: r for r in linkgraph.judge(d).collect()}
    assert got[0].verdict == "block" and got[1].rule is None and got[1].distrust > 0 and got[1].verdict == "block"


@pytest.mark.parametrize("name", ["op4_vp_tree", "op6_minhash_join"])
def test_oracle(spark, name):
    from shoalmark import llm

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = llm.queries()[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols)
    assert sorted(key(r.asDict()) for r in df.collect()) == sorted(map(key, con.sql(llm.oracle_sql()[name]).to_arrow_table().to_pylist()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.keep(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == n
