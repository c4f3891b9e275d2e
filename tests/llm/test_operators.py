"""The ten operators against brute force, round trips and held-out labels, with nulls, ties, repeated rows and empty tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, common, components, exact_dedup, jaccard_join, license_scan, mixing, nearest, packing, quality, sharding, url_filter
from millrace.llm.components import connected_components, forest
from millrace.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, kept string"
SPACES = b" \t\n\x0b\x0c\r"


def docs_of(spark, texts, sources=None, ids=None):
    """Rows with columns whose names clash with results."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", "z") for i, t, s in zip(ids, texts, sources)], SCHEMA)


def odd_texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta,", "eps", "Zeta", "eta.", "theta", "iota", "kappa\u00e9", "\u0130x", "\u4e2d\u6587"]
    base = [" ".join(rng.choices(words, k=n)) for n in (1, 2, 3, 4, 5, 30, 60, 60, 120, 400)]
    near = []
    for t in base[5:]:
        for _ in range(6):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    return [None, "", " \t\n", "a", "A", *base, *base[:3], *near, "x" * 200_000, " ".join(["long"] * 50_000), "tab\x0band\x1fnot\u00a0space", "a  b", "ab", "a b "]


def links(texts, words, num, den):
    def bag(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    sets = [bag(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return sets, pairs


def brute_components(n, pairs):
    root = list(range(n))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = up(i), up(j)
        root[max(a, b)] = min(a, b)
    return [up(i) for i in range(n)]


@pytest.mark.parametrize(("words", "num"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, words, num):
    texts = odd_texts()
    sets, pairs = links(texts, words, num, 100)
    want = brute_components(len(texts), pairs)
    n = np.bincount(np.array(pairs, int).ravel(), minlength=len(texts))
    got = {r.doc_id: r for r in jaccard_join.similar_documents(docs_of(spark, texts), words, num, 100).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(sets[i]), want[i], n[i])


def link_table(texts, words, num, den):
    _, pairs = links(texts, words, num, den)
    n = np.bincount(np.array(pairs, int).ravel(), minlength=len(texts))
    return {i: (c, n[i]) for i, c in enumerate(brute_components(len(texts), pairs))}


def edited(rng, base, most, times, name):
    """Copies of a list of words with up to so many words replaced."""
    out = []
    for k in range(times):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"{name}{k}x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("case", "pivots"), [("dense", 1), ("both", 1), ("both", 1024)])
def test_jaccard_regions_split_across_tasks(spark, monkeypatch, case, pivots):
    """Small limits: regions are split by pivots over several levels, or cut into bands of which only some are compared."""
    rng = random.Random(5)
    texts = []
    if case != "spread":  # one family, all of which links or nearly so
        texts += edited(rng, [f"w{i}" for i in range(80)], 3, 120, "d")
    if case != "dense":  # families that lie next to each other: a common half, and near copies of each
        for c in range(8):
            base = [f"w{i}" for i in range(50)] + [f"c{c}w{i}" for i in range(30)]
            texts += edited(rng, base, 4, 14, f"s{c}")
    monkeypatch.setattr(jaccard_join, "GROUP", 24)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)  # shared shingles tie everything to one group
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.similar_documents(docs_of(spark, texts), 4, 85, 100).collect()}
    assert got == link_table(texts, 4, 85, 100)


def test_jaccard_hot_shingles(spark, monkeypatch):
    """Very frequent shingles are dealt by row, and counts beyond a byte survive the sketch."""
    monkeypatch.setattr(jaccard_join, "HOT", 300)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    rng = random.Random(4)
    texts = ["all the same short words here " + f"t{rng.randrange(90)}" for _ in range(500)]
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.similar_documents(docs_of(spark, texts), 4, 60, 100).collect()}
    assert got == link_table(texts, 4, 60, 100)
    part, total = np.random.default_rng(1).integers(0, 400, jaccard_join.SLICE).astype(np.uint32), np.zeros(jaccard_join.SLICE, np.uint32)
    for counts in (part, np.where(part < 380, 0, part).astype(np.uint32)):
        jaccard_join._add_counts(total, jaccard_join._counts(counts))
    assert (total == part + np.where(part < 380, 0, part)).all()


def placed_rows(spark, texts, words, num, den):
    rows = docs_of(spark, texts).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    profile = common.cut(rows.mapInPandas(jaccard_join._profiles(words, False), "id long, row binary, n long, key long, slice int, counts binary"))
    classes = profile.where("slice = -1").groupBy("key", "n").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    return jaccard_join._placed(rows, profile, classes, words, num, den)


def test_jaccard_regions_prune(spark, sf):
    """On ordinary documents regions leave few comparisons, and blocks of a dense family are told by their bands."""
    texts = [r.text for r in spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").select("text").collect()]
    sizes = [r["count"] for r in placed_rows(spark, texts, 5, 80, 100).groupBy("region").count().collect()]
    assert sum(n * n for n in sizes) < 0.02 * len(texts) ** 2 and any(n > 1 for n in sizes)
    family = edited(random.Random(9), [f"w{i}" for i in range(300)], 2, 400, "f")
    rows = placed_rows(spark, family, 4, 85, 100)
    assert rows.groupBy("region").count().count() <= 400


def test_jaccard_dense_families_shuffle_less_than_quadratically(spark, monkeypatch):
    """Documents that are brought together for comparison, when a family of near copies grows fourfold."""
    monkeypatch.setattr(jaccard_join, "GROUP", 16)
    met = []
    old = jaccard_join._group

    def counted(num, den):
        task = old(num, den)

        def run(rows):
            seen.add(len(rows))
            return task(rows)

        return run

    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(jaccard_join, "_group", counted)
    for times in (100, 400):
        before = seen.value
        texts = edited(random.Random(9), [f"w{i}" for i in range(400)], 2, times, "f")
        got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.similar_documents(docs_of(spark, texts), 4, 85, 100).collect()}
        assert got == link_table(texts, 4, 85, 100)
        met.append(seen.value - before)
    assert met[1] < 8 * max(met[0], 16)


def test_jaccard_pivots_split_cells(monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(f"c{c}w{i}" if rng.random() > 0.02 else f"x{rng.random()}" for i in range(60)) for c in range(30) for _ in range(8)]
    monkeypatch.setattr(jaccard_join, "CELL", 16)
    i, j = jaccard_join._linked([common.shingles(t, 4) for t in texts], 60, 100)
    assert sorted(zip(i.tolist(), j.tolist())) == links(texts, 4, 60, 100)[1]


def test_jaccard_repeated_and_null_ids(spark):
    texts = ["one two three four five six"] * 3 + ["seven eight nine ten eleven"]
    got = jaccard_join.similar_documents(docs_of(spark, texts, ids=[5, 5, None, None]), 4, 85, 100).collect()
    assert sorted((r.doc_id is None, r.component_id or -1, r.n_links) for r in got) == [(False, 5, 2), (False, 5, 2), (True, -1, 0), (True, 5, 2)]
    assert jaccard_join.one_of_each(docs_of(spark, texts, ids=[5, 5, 6, 7])).count() == 2


def test_stages_decide_by_row(spark):
    """Null ids and ids that repeat with different texts: rows stay or go by their own text in all three stages."""
    words = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(6)]
    rows = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect()))
    # Different texts under null ids and under id 4, one of which is a copy of document 1; 7 repeats in full.
    docs = docs_of(spark, [words[0], words[0], words[1], words[2], words[3], words[4], words[4], words[3]], ids=[1, 4, 4, None, None, 7, 7, None])
    want = sorted([(False, 1, words[0]), (False, 4, words[1]), (True, 0, words[2]), (True, 0, words[3]), (False, 7, words[4])])
    assert rows(exact_dedup.drop_duplicates(docs)) == want
    assert rows(jaccard_join.one_of_each(docs)) == want
    # Two components whose smallest id is 4, near copies under null ids, and texts without words.
    near = [w + " more" for w in words]
    docs = docs_of(spark, [words[0], near[0], words[1], near[1], words[2], near[2], "", " ", None], ids=[4, 5, 4, 6, None, None, None, 8, None])
    got = rows(jaccard_join.one_of_each(docs, 2, 80, 100).fillna("", ["text"]))
    assert [r for r in got if r[2] not in (words[2], near[2])] == sorted([(False, 4, words[0]), (False, 4, words[1]), (False, 8, " "), (True, 0, "")]) and len(got) == 5
    # Texts that differ in blanks only: the longest stays.
    assert rows(exact_dedup.drop_duplicates(docs_of(spark, ["ab", "a b", "a  b", "c"], ids=[4, 4, 9, None]))) == [(False, 9, "a  b"), (True, 0, "c")]
    good, bad = "Some quiet words. " * 30, "!!! $$$ " * 40
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 400)], "doc_id long, quality int")
    docs = docs_of(spark, [good if i % 2 else bad for i in range(100, 400)] + [good, bad, good, bad], ids=[*range(100, 400), None, None, 5, 5])
    kept = quality.keep_good(docs, labels)
    assert rows(kept.where("doc_id is null or doc_id = 5")) == [(False, 5, good), (True, 0, good)] and kept.columns == docs.columns


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(500, k) for k in range(501, 600)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = brute_components(600, edges)
    assert got == {n: want[n] for n in {x for e in edges for x in e if e[0] != e[1]}}
    nodes, roots = forest(np.array([3, 9]), np.array([9, 1]))
    assert nodes.tolist() == [1, 3, 9] and roots.tolist() == [1, 1, 1]


def jobs_of(spark, f):
    """What f returns, and how many jobs it ran."""
    sc = spark.sparkContext
    group = f"counted-{random.random()}"
    sc.setJobGroup(group, "")
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)


@pytest.mark.parametrize("few", [1 << 20, 50, 0])
def test_components_end_in_one_task(spark, monkeypatch, few):
    """A path needs most rounds: with few edges there are none, with more the rounds go on until few are left."""
    monkeypatch.setattr(components, "FEW", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(50)] + [(7, 7)], "a long, b long").repartition(9)
    got, jobs = jobs_of(spark, lambda: {r.node: r.root for r in connected_components(edges).collect()})
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(51)}
    assert few < 1 << 20 or jobs <= 6
    assert connected_components(edges.where("a < 0")).count() == 0


PARTITIONS, COALESCE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"


@pytest.mark.parametrize("stage", [False, True])
def test_jaccard_jobs_do_not_grow_with_partitions(spark, stage):
    """Partitions that nobody merges, as in large runs: the driver remembers every stage and task. A path of near copies; stage: as in the pipeline."""
    words = [f"w{k}" for k in range(140)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 80, 4)] + ["alone " * 30]
    want = dict(enumerate(brute_components(len(texts), links(texts, 5, 80, 100)[1])))
    old = {k: spark.conf.get(k) for k in (PARTITIONS, COALESCE)}
    jobs = []
    try:
        spark.conf.set(COALESCE, "false")
        for n in ("2", "40"):
            spark.conf.set(PARTITIONS, n)
            f = jaccard_join.one_of_each if stage else jaccard_join.similar_documents
            rows, k = jobs_of(spark, lambda: f(docs_of(spark, texts), 5, 80, 100).collect())  # noqa: B023
            assert sorted(r.doc_id for r in rows) == sorted(set(want.values())) if stage else {r.doc_id: r.component_id for r in rows} == want
            jobs.append(k)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert jobs[1] <= jobs[0] + 20, jobs


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup(spark, digest_bytes):
    """With one byte of digest most hits are false, and byte verification must part them."""
    texts = odd_texts()
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs_of(spark, texts).repartition(3), digest_bytes=digest_bytes, memtable=4).collect()}
    bare = [(t or "").encode().translate(None, SPACES) for t in texts]
    for i, b in enumerate(bare):
        group = [k for k, x in enumerate(bare) if x == b]
        keep = min(group, key=lambda k: (-len(texts[k] or ""), k))
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(group), keep == i, hashlib.sha256(b).hexdigest())


def test_exact_dedup_repeated_and_null_ids(spark):
    docs = docs_of(spark, ["a b", "ab", "ab", None], ids=[None, 4, 4, 9])
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    assert got == [(-1, -1, 3, True), (4, -1, 3, False), (4, -1, 3, False), (9, 9, 1, True)]
    assert exact_dedup.drop_duplicates(docs_of(spark, ["ab", "ab", "c"], ids=[4, 4, 5])).count() == 2


def test_index_merges_runs():
    index = exact_dedup.Index(memtable=3, runs=2)
    rng = random.Random(2)
    rows = [(bytes([rng.randrange(40)]) * 8, rng.randrange(5), k) for k in range(500)]
    for r in rows:
        index.put(*r)
    out = index.close()
    for d, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        group = list(group)
        r = out[out.digest == d].iloc[0]
        assert ((r.chars, r.id), r.n) == ((max(g[1] for g in group), min(g[2] for g in group if g[1] == max(x[1] for x in group))), len(group))


def test_sharding(spark):
    texts = [*odd_texts(), *["copy of one text"] * 400]
    rows = sharding.shard_by_bytes(docs_of(spark, texts), 5).toPandas().set_index("doc_id")
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows["size"][i] == len((t or "").encode()) + 16 and rows["text_crc32"][i] == zlib.crc32((t or "").encode())
    for _, slots in rows.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    assert rows.shard.between(0, 4).all()
    even = sharding.shard_by_bytes(docs_of(spark, ["copy"] * 900), 9).toPandas()  # one key holds all rows
    assert even.groupby("shard").size().tolist() == [100] * 9
    assert sharding.shard_by_bytes(docs_of(spark, ["a", "b"], ids=[None, None]), 3).count() == 2


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*odd_texts(), "say <|endoftext|> now", "e\u0301 \u0301x don't 12a", "\u03a3\u03a3 \u0130"]
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = packing.pack(docs_of(spark, texts).repartition(2), tokenizer_path("word_bpe_49k.json"), length=256, block=16).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum()][:-1] and own.length.sum() == len(ids) // 4 == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()][:-1]
    used = rows.groupby("sequence_id").length.sum()
    assert used.max() <= 256 and all(n & (n - 1) == 0 for n in used)


def test_assign_prefers_cheap_sequences():
    room = np.array([100, 100])
    placed = packing.assign(np.array([60, 50, 50, 40]), room)
    assert sorted(placed) == [(0, 0, 60, 0), (1, 0, 50, 1), (2, 0, 50, 1), (3, 0, 40, 0)] and not room.any()


def test_quality(spark, sf):
    docs, labels = (spark.read.parquet(sf.replace("0.001", "0.01") + f"/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels).toPandas().set_index("doc_id")
    y = labels.toPandas().set_index("doc_id").quality
    held = got.join(y, how="inner")[lambda x: x.held_out]
    assert len(got) == docs.count() and (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([(0, None), (None, 1), (3, 1), (3, 0), (2, 7)], "doc_id long, quality int")
    got = quality.score(docs_of(spark, odd_texts()), labels).toPandas()
    assert len(got) == len(odd_texts()) and (got.score == 0.5).all()


def test_flat_trees_match_walking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, trees=20, depth=3)
    b = m.binned(x)
    for r in range(0, 500, 50):
        total = m.base
        for f, t, v in zip(m.feature, m.bin, m.value):
            k = 0
            while k < len(f):
                k = 2 * k + (2 if b[r, f[k]] > t[k] else 1)
            total += v[k - len(f)]
        assert m.score(x[r : r + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((m.score(x) > 0.5) == (y == 1)).mean() > 0.95


def test_mixing(spark):
    texts = odd_texts()
    sources = [["b", "a", None, "\u00e9", "B"][i % 5] for i in range(len(texts))]
    got = mixing.mix(docs_of(spark, texts, sources)).toPandas().set_index("doc_id")
    size = {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    names = sorted({s for s in sources if s is not None}) + [None]
    total = {s: sum(size[i] for i, x in enumerate(sources) if x == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    for i, s in enumerate(sources):
        assert (got["size"][i], got.source_size[i]) == (size[i], total[s]) and got.target[i] == pytest.approx(target[s]) and got.taken[i] <= 2 * size[i]
    for s in names:
        assert got.taken[[i for i, x in enumerate(sources) if x == s]].sum() == round(target[s])
    rows = mixing.mixed_documents(docs_of(spark, texts, sources)).toPandas()
    assert rows.text.map(lambda t: len((t or "").encode().split())).sum() == got.taken.sum()


def test_mixed_documents_of_repeated_and_null_ids(spark):
    """Rows that repeat, or have null ids and equal sizes, count and are taken each by itself."""
    texts = [f"t{i % 50} b c d" for i in range(100)] + ["same text here"] * 30 + [f"other {i} x" for i in range(40)] + ["", None, ""]
    ids = [None] * 100 + [7] * 30 + list(range(100, 140)) + [None] * 3
    sources = ["a"] * 60 + ["b"] * 40 + ["a"] * 15 + ["b"] * 15 + ["c"] * 40 + ["a"] * 3
    docs = docs_of(spark, texts, sources, ids)
    rows = mixing.mixed_documents(docs).toPandas()
    size = rows.text.map(lambda t: len((t or "").split()))
    words = size.groupby(rows.source).sum()
    totals = {s: sum(len((t or "").split()) for t, x in zip(texts, sources) if x == s) for s in "abc"}
    target, left, open_ = {}, 1.5 * sum(totals.values()), dict(zip("abc", (3, 1, 2)))
    while any(left * w / sum(open_.values()) > 2 * totals[s] for s, w in open_.items()):
        full = [s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * totals[s]]
        target |= {s: 2 * totals[s] for s in full}
        left, open_ = left - sum(target[s] for s in full), {s: w for s, w in open_.items() if s not in full}
    target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    assert words.to_dict() == {s: round(t) for s, t in target.items()}
    cut = (size > 0) & ~rows.text.isin(texts)
    assert cut.groupby(rows.source).sum().max() <= 1 and set(rows.columns) == set(docs.columns)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 12)) * rng.uniform(0.2, 3, size=(700, 1))
    x[100:300] = x[100]  # a third are the same vector
    rows = [(i, [float(np.float32(c)) for c in v], None) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [None] + [1.0] * 11, 1), (1003, [float("nan")] * 12, 1), (1004, [], 1), (None, [1.0] * 12, 1), (1020, [2.0, 1.0], 1), (1040, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    good = {i: np.array(v, float) for i, v, _ in rows[:700]}
    exact = nearest.nearest(df, F.col("id") % 20 == 0, 20, factor=1.0, shard_rows=200).toPandas()
    for q in range(0, 700, 20):
        want = sorted(((-float((v * good[q]).sum()), i) for i, v in good.items() if i != q))[:20]
        own = exact[exact.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own.vec_id.tolist() == [i for _, i in want]
        assert own.score.to_numpy() == pytest.approx([-s for s, _ in want])
    assert exact[exact.query_id == 1020][["rank", "vec_id", "score"]].values.tolist() == [[1, 1040, 3.0]]


def brute_nearest(ids, x, queries, k=20):
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -np.inf
    return {int(ids[q]): set(ids[np.argsort(-row, kind="stable")[:k]].tolist()) for q, row in zip(queries, scores)}


def test_nearest_recall_over_shards(spark, sf):
    """Recall against brute force over 8 shards or more, and how many shards a query visits."""
    df = spark.read.parquet(sf.replace("0.001", "0.1") + "/embeddings.parquet")
    table = df.toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    want = brute_nearest(ids, x, np.flatnonzero(ids % 20 == 0))
    got = nearest.nearest(df, F.col("id") % 20 == 0, 20, shard_rows=200).toPandas()
    assert sum(len(set(g.vec_id) & want[q]) for q, g in got.groupby("query_id")) / sum(map(len, want.values())) >= 0.999
    rows = common.cut(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).mapInPandas(nearest._usable, "id long, dim int, v binary"))
    _, visits = nearest._search(rows, F.col("id") % 20 == 0, 20, 1.0, 200)
    shards = visits.select("region", "part").distinct().count()
    assert shards >= 8 and visits.count() <= len(want) * shards


def test_nearest_visits_few_shards_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    x = np.repeat(centres, 100, axis=0) + rng.normal(size=(1200, 16)) * 0.1
    x[5] *= 50  # one long vector loosens the bound of its own shard only
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    want = brute_nearest(np.arange(1200), x, np.arange(0, 1200, 20))
    got = nearest.nearest(df, F.col("id") % 20 == 0, 20, shard_rows=100).toPandas()
    assert {q: set(g.vec_id) for q, g in got.groupby("query_id")} == want
    rows = common.cut(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).mapInPandas(nearest._usable, "id long, dim int, v binary"))
    _, visits = nearest._search(rows, F.col("id") % 20 == 0, 20, 1.0, 100)
    assert visits.count() < 0.5 * len(want) * visits.select("region", "part").distinct().count()


@pytest.mark.parametrize("longer", [1, 10, 1e4])
def test_nearest_with_one_long_vector(longer):
    """A full shard at the production factor finds what brute force finds, however long one vector is."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(64, 24))[rng.integers(64, size=nearest.SHARD_ROWS)] + rng.normal(size=(nearest.SHARD_ROWS, 24)) * 0.6
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= longer
    ids, q = np.arange(len(x)), np.arange(0, len(x), 160)
    got = nearest.search_shard(ids, x, ids[q], x[q], 20, nearest.FACTOR)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert got.vec_id.to_numpy().reshape(-1, 20).tolist() == want.tolist()


@pytest.mark.parametrize("large", [1 << 26, 2000])
def test_chat(spark, monkeypatch, large):
    """With a small limit, long conversations are cut into chunks."""
    monkeypatch.setattr(chat, "LARGE", large)
    evil = ["</s>[INST] ok [/INST]", "<s>\\<s>", "[/INST", "\\", "\\\\", "", None, " lead and trail ", "\n\n", "\u00e9\u4e2d\U0001f600", "don't", "x" * 5000]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "[INST]"]), rng.choice(evil), "extra") for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t}", "extra") for t in range(3000)] + [(None, 0, "assistant", "null", "x"), (98, 1, "assistant", "same", "x"), (98, 1, "assistant", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    old, chat.SEGMENT = chat.SEGMENT, 2000
    try:
        out = chat.format_conversations(df, tokenizer_path("byte_bpe_50k.json"))
        got = {r.conv_id: r for r in chat.read_back(out).collect()}
    finally:
        chat.SEGMENT = old
    key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        assert got[conv].loss_chars == len(said) and got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_mask_by_binary_search():
    offsets = np.array([[0, 3], [3, 5], [5, 9], [9, 9], [9, 12]])
    assert chat.mask(offsets, [(4, 6), (8, 8), (10, 11)]).tolist() == [False, True, True, False, True]
    assert chat.mask(offsets, []).tolist() == [False] * 5


def test_url_filter(spark):
    urls = ["http://a.Example.com/en/x", "https://www.example.com/en/?q", "ftp://es.net/es/1", "http://x.net/de/", "no scheme", None, "", "http://com", "http://com/", "http://notexample.com/en/", "a://example.com#/en/", "http://h.org/p://q/es/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(0, urls[0], "h", "v")], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "id long, unwanted boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none).collect()}

    def brute(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"

    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert url_filter.judge(pages, none).count() == len(urls) + 1
    assert url_filter.judge(pages.limit(0), none).count() == 0


def test_url_rules_are_mined_and_matched(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"http://{'free-bets' if bad else rng.choice(['news', 'free-mail', 'top-bets'])}.{rng.choice(['org', 'info'])}/{rng.randrange(50)}", bad))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:300]], "id long, unwanted boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, rules=()).collect()}
    assert got == {r[0]: "block" if r[2] else "allow" for r in rows}
    tokens = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "id long, url string, unwanted boolean").select("unwanted", "url", url_filter.tokens_of(F.col("url")).alias("tokens"))
    mined = url_filter.mine(tokens).collect()
    everything = tokens.collect()
    for rule in mined:
        fit = [r.unwanted for r in everything if all(set(x) & set(r.tokens) for x in rule["items"])]
        assert sum(fit) / len(fit) == pytest.approx(rule.confidence) and rule.confidence >= url_filter.CONFIDENCE


def test_url_verdicts_match_all_itemsets(spark):
    """Against every combination of tokens that has the support and the confidence, however long; some tokens always come together."""
    rng = random.Random(2)
    rows = []
    for i in range(160):
        t = [x for x in "abcdef" if rng.random() < 0.45]
        t += ["tw", "in"] if rng.random() < 0.5 else []
        rows.append((i, "http://h.org/" + "/".join(t or ["z"]), ("a" in t and "tw" in t) or ("c" in t and "d" in t and rng.random() < 0.9) or rng.random() < 0.05))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, unwanted boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, rules=(), support=0.03, confidence=0.8).collect()}
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", url_filter.tokens_of(F.col("url")).alias("t")).collect()}
    every = sorted(set().union(*tokens.values()))
    found = []
    for n in range(1, 6):
        for x in map(frozenset, itertools.combinations(every, n)):
            fit = [r[2] for r in rows if x <= tokens[r[0]]]
            if sum(fit) >= 0.03 * len(rows) and sum(fit) >= 0.8 * len(fit):
                found.append(x)
    assert got == {r[0]: "block" if any(x <= tokens[r[0]] for x in found) else "allow" for r in rows}


def test_url_rules_of_sites_with_many_common_tokens(spark):
    """Urls that share 25 path words: two to the power of 25 itemsets, of which one item is left."""
    path = "/".join(f"x{chr(97 + k)}" for k in range(25))
    rows = [(i, f"http://long.site/{path}/{'bad' if i % 3 else 'good'}{'qrs'[i % 2]}", bool(i % 3)) for i in range(60)] + [(i, f"http://s{chr(97 + i % 9)}.net/p", False) for i in range(60, 300)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, unwanted boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, rules=()).collect()}
    assert got == {r[0]: "block" if r[2] else "allow" for r in rows}


def test_url_rule_of_four_tokens(spark):
    """Only all four tokens together are unwanted; any three of them are wanted as often."""
    four = ["aa", "bb", "cc"]
    urls = []
    for k in range(40):
        urls.append(("http://aa.bb.cc/dd/", True))
        for left in range(4):
            t = [*four, "dd"]
            t[left] = f"w{'xyz'[k % 3]}"
            urls.append((f"http://{t[0]}.{t[1]}.{t[2]}/{t[3]}/", False))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls)], "id long, unwanted boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, rules=()).collect()}
    assert got == {i: "block" if b else "allow" for i, (_, b) in enumerate(urls)}


def test_license_scan(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (0, "a/LICENSE", mit), (1, "a/x.txt", "some words"), (2, "a/b/c/y.txt", None), (3, "a/b/LICENSE.txt", gpl), (4, "a/b/z.txt", "prose\n" + mit + "\nprose"),
        (5, "d/x.txt", ""), (6, None, "none"), (7, "a/notes", gpl), (8, "d/COPYING", "no licence here"), (9, "LICENSE", gpl.upper()), (1, "a/x.txt", "some words"), (10, "e/f", "licensed under the of and " * 30_000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    got = sorted(((r.doc_id, r.own_license, r.license, r.license_from) for r in license_scan.scan(df).collect()), key=str)
    assert got == sorted([(0, "MIT", "MIT", None), (1, None, "MIT", "a"), (2, None, "GPL-3.0", "a/b"), (3, "GPL-3.0", "GPL-3.0", None), (4, "MIT", "MIT", None), (5, None, "GPL-3.0", ""), (6, None, None, None), (7, "GPL-3.0", "GPL-3.0", None), (8, None, "GPL-3.0", ""), (9, "GPL-3.0", "GPL-3.0", None), (1, None, "MIT", "a"), (10, None, "GPL-3.0", "")], key=str)


WRAPPED = {
    "BSD-3-Clause": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:\n",
    "MIT": """/* Permission is hereby granted, free of charge, to any person obtaining
 * a copy of this software and associated documentation files (the
 * "Software"), to deal in the Software without restriction, including
 * without limitation the rights to use, copy, modify, merge, publish. */\n""",
    "GPL-3.0": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.\n""",
    "Apache-2.0": """-- Licensed under the Apache License, Version 2.0 (the "License");
-- you may not use this file except in compliance with the License.\n""",
}
MIT_FILE = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_license_headers_wrapped_over_lines(spark, sf):
    """Headers above code, notices inside a long line, and whole licence files; not those of other licences."""
    code = "".join(f"x{i} = call{i}(y{i}, {i})\n" for i in range(60))
    rows = [(name, f"a/{name}.c", text + code, name) for name, text in WRAPPED.items()]
    rows += [(name, f"b/{name}.txt", code.replace("\n", " ") + text.replace("\n", " ") + code.replace("\n", " "), name) for name, text in WRAPPED.items()]
    rows += [("f", "c/LICENSE", MIT_FILE, "MIT"), ("g", "c/d/x.txt", "prose", "MIT")]
    rows += [("h", "e/LICENSE", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n" + code, "GPL-3.0"), ("i", "f/LICENSE", "Mozilla Public License\nVersion 2.0\n\n" + code, "MPL-2.0")]
    rows += [("j", "g/LICENSE", "Attribution 4.0 International\n\nCreative Commons Attribution 4.0 International Public\nLicense\n" + code, "CC-BY-4.0")]
    gpl = WRAPPED["GPL-3.0"]
    rows += [("k", "h/x", gpl.replace("version 3", "version 2") + code, None), ("l", "h/y", gpl.replace("GNU General", "GNU Lesser General") + code, None), ("m", "h/z", code, None), ("n", "h/v", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n" + code, None)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    common_words = spark.read.parquet(sf + "/documents.parquet").select("doc_id", F.lit("none/x").alias("path"), "text")
    files = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string").union(common_words.withColumn("doc_id", -1 - F.col("doc_id")))
    got = {r.doc_id: r.license for r in license_scan.scan(files).where("doc_id >= 0").collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_license_cosines_match_brute_force(spark, sf):
    docs = spark.read.parquet(sf + "/documents.parquet").withColumn("path", F.concat(F.lit("d/"), F.col("doc_id")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for t in texts.values():
        for w in set(license_scan.words(t)):
            seen[w] = seen.get(w, 0) + 1
    m = license_scan.Matcher(license_scan.TEMPLATES, seen, len(texts))
    got = {r.doc_id: r.own_license for r in license_scan.scan(docs).collect()}
    for i, t in texts.items():
        bags = [license_scan.Counter(license_scan.words(x)) for x in [*t.split("\n"), t]]
        c = np.array([m.cosines(b) for b in bags])
        best = np.unravel_index(c.argmax(), c.shape)
        assert got[i] == (m.names[best[1]] if c.max() >= license_scan.LEAST else None)


def test_empty_tables(spark):
    none = docs_of(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert jaccard_join.similar_documents(none).count() == 0
    assert license_scan.scan(none.withColumn("path", F.lit("x"))).count() == 0
    assert sharding.shard_by_bytes(none).count() == 0
    assert packing.pack(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0
    assert quality.score(none, labels).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_stages_pass_columns_whose_names_clash(spark):
    """Extra columns named like helpers come out as they went in."""
    names = ["id", "part", "epochs", "row", "key", "size", "source2", "_kept_id", "n"]
    texts = ["one two three four five six seven", "one two three four five six seven", "other words here", None]
    docs = spark.createDataFrame([(i, t, "s", *(f"{c}{i}" for c in names)) for i, t in enumerate(texts)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for stage in (lambda d: quality.keep_good(d, labels), exact_dedup.drop_duplicates, jaccard_join.one_of_each, mixing.mixed_documents):
        got = stage(docs)
        assert got.columns == docs.columns and all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in names)
