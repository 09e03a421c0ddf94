"""The pipeline's stages, one after another as the driver runs them, against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus_helpers import frame, prose, tricky_texts
from test_pairs import grams

import corpus_pipeline
from rowdelta.llm import mixing, packing, pii
from rowdelta.llm.queries import tokenizer_paths

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    rows, labels = tricky_texts(), []
    for k in range(100, 500):
        toxic = int(k % 5 == 0)
        words = prose(k, rng.randrange(40, 90)).split()
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "grossness"]))
        rows.append((k, " ".join(words), f"s{k % 7}"))
        labels.append((k, 1, toxic))
    for k in range(600, 610):  # near copies of a clean text
        words = prose(101, 120).split()
        words[k - 600] = "edited"
        rows.append((k, " ".join(words), "s1"))
    path = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, rows).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, {k for k, _, t in labels if t}


def test_stages(spark, corpus, tmp_path):
    path, rows, toxic = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept: dict[str, list] = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    clean = [r for r in rows if r[0] not in toxic]
    assert Counter((r.doc_id, r.text) for r in kept["toxicity"]) == Counter((i, t) for i, t, _ in clean)
    left: list[tuple] = []
    for i, t, s in sorted(clean, key=lambda r: (r[0] is None, r[0] or 0)):
        a = grams(t)
        if not a or not any(len(a & grams(u)) >= 0.8 * len(a | grams(u)) for _, u, _ in left if grams(u)):
            left.append((i, t, s))
    assert Counter(r.doc_id for r in kept["ngram_jaccard"]) == Counter(i for i, _, _ in left)
    assert Counter((r.doc_id, r.text) for r in kept["pii"]) == Counter((i, None if t is None else pii.mask(t)) for i, t, _ in left)
    assert not any(k in pii.BASE_KINDS for r in kept["pii"] for k, _, _ in pii.find(r.text or ""))
    words = Counter()
    for r in kept["mixing"]:
        words[r.source] += len(WORD.findall(r.text))
    goals = mixing.mix(spark.read.parquet(f"{tmp_path}/pii")).select("source", "target").distinct().collect()
    assert all(abs(words[g.source] - g.target) <= 1 for g in goals)
    ids = Counter()
    for r in kept["mixing"]:
        ids[r.doc_id] += len(packing.token_ids(r.text, **tokenizer_paths())) + 1
    packed = Counter()
    for r in kept["packing"]:
        packed[r.doc_id] += r.length
    assert packed == ids
    fill = Counter()
    for r in kept["packing"]:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and np.mean(list(fill.values())) > 900


def test_run_is_the_stages(spark, corpus):
    path, _, _ = corpus
    assert corpus_pipeline.run(spark, path).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "pii", "mixing", "packing"]


@pytest.mark.parametrize("stage", range(1, 5))
def test_stages_take_empty_tables(spark, nothing, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, nothing, "unused").collect() == []


def test_toxicity_of_an_empty_table(spark, nothing, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.STAGES[0][1](spark, nothing, str(tmp_path)).collect() == []
