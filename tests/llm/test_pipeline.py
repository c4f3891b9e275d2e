"""The pipeline's stages, each written and read again, against brute force on its own input."""

import itertools
import zlib

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import mixing, quality
from millrace.llm.queries import tokenizer_path


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Pandas frames of the input and of each stage's result, by name."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {"input": docs.toPandas()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        found[name] = docs.toPandas()
    return found


def test_stages_keep_the_columns(stages):
    frames = list(stages.values())
    assert all(list(f.columns) == list(frames[0].columns) for f in frames[:-1])


def test_classifier_rejects(spark, sf, stages):
    scores = quality.score(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    assert sorted(stages["quality classifier"].doc_id) == sorted(scores[scores.predicted == 1].doc_id)


def test_exact_dedup_keeps_one(stages):
    best = {}
    for i, t in zip(stages["quality classifier"].doc_id, stages["quality classifier"].text):
        bare = (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")
        best[bare] = min(best.get(bare, (1, 0)), (-len(t or ""), i))
    assert sorted(stages["exact dedup"].doc_id) == sorted(i for _, i in best.values())


def test_near_copies_keep_one(stages):
    ids, texts = (stages["exact dedup"].sort_values("doc_id")[c].tolist() for c in ("doc_id", "text"))
    sets = [shingles(t) for t in texts]
    group = list(range(len(ids)))
    for i, j in itertools.combinations(range(len(ids)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    assert sorted(stages["n-gram Jaccard join"].doc_id) == sorted({ids[g] for g in group})


def test_mix_meets_its_budgets(spark, stages):
    before, after = stages["n-gram Jaccard join"], stages["mixing"]
    size = lambda f: f.text.map(lambda t: len((t or "").encode().split()))
    words = size(after).groupby(after.source).sum()
    target = mixing.mix(spark.createDataFrame(before)).toPandas().set_index("doc_id")
    for s, ids in before.groupby("source").doc_id:
        assert words.get(s, 0) == round(target.target[ids].iloc[0])
    assert (after.groupby("doc_id").size() <= 2).all()


def test_packing_loses_no_token(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    packed, docs = stages["packing"], stages["mixing"]
    tokens = {}
    for text in docs.text:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        tokens[len(tokens)] = ids
    assert packed.length.sum() == sum(map(len, tokens.values())) and packed.groupby("sequence_id").length.sum().max() <= 2048
    whole = {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in tokens.values()}
    uncut = packed[packed.length == packed.doc_tokens]
    assert all((n, c) in whole for n, c in zip(uncut.length, uncut.ids_crc32))


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() > 0
