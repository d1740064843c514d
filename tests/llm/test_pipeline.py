"""The corpus pipeline, stage by stage, each held against its own input."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from conftest import DATA
from strandpack.llm import common, mixing, pieces, quality, secrets, simhash


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    sf = str(DATA / "sf0.01")
    if not (DATA / "sf0.01").exists():
        pytest.skip("no test tables")
    base = tmp_path_factory.mktemp("pipeline")
    docs = common.table(spark, sf, "documents")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"file://{base}/{k}")
        docs = spark.read.parquet(f"file://{base}/{k}")
        out.append(docs)
    return out


def test_stages_return_the_columns_of_documents(steps):
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "secrets", "mixing", "pieces"]
    assert all(s.columns == steps[0].columns for s in steps[1:5])


def test_quality_stage(spark, steps):
    labels = {r.doc_id: r.quality for r in common.table(spark, str(DATA / "sf0.01"), "labels").collect()}
    kept = {r.doc_id for r in steps[1].select("doc_id").collect()}
    of = lambda q: np.mean([i in kept for i, x in labels.items() if x == q])
    assert of(1) > 0.97 and of(0) < 0.15


def test_dedup_stage(steps):
    rows = {r.doc_id: r.text for r in steps[1].select("doc_id", "text").collect()}
    kept = {r.doc_id for r in steps[2].select("doc_id").collect()}
    shingles = {i: set(simhash.shingle_hashes(t, 5)) for i, t in rows.items()}
    inverse = {}
    for i, s in shingles.items():
        for h in s:
            inverse.setdefault(h, []).append(i)
    shared = Counter((a, b) for ids in inverse.values() if len(ids) < 60 for k, a in enumerate(ids) for b in ids[k + 1 :])
    close = {p: n / (len(shingles[p[0]]) + len(shingles[p[1]]) - n) for p, n in shared.items()}
    for least, missed in ((0.9, 0.02), (0.8, 0.08)):
        both = [p for p, j in close.items() if j >= least and p[0] in kept and p[1] in kept]
        assert len(both) <= missed * sum(j >= least for j in close.values())
    partner = {i for p, j in close.items() if j >= 0.7 for i in p}
    assert np.mean([i in kept for i in rows if i not in partner]) > 0.99
    alone = [i for i in rows if not any(j >= 0.4 for p, j in close.items() if i in p)]
    assert np.mean([i in kept for i in alone]) > 0.99


def test_secrets_stage(steps):
    enc = secrets.encoding(secrets.default_vocabulary())
    before = {r.doc_id: r.text for r in steps[2].collect()}
    for r in steps[3].collect():
        base, every = secrets.find(before[r.doc_id], enc)
        assert r.text == (secrets.masked(before[r.doc_id], every) if every else before[r.doc_id])
        assert r.n_chars == len(r.text)
    assert steps[3].count() == steps[2].count()


def test_mixing_stage(steps):
    counts = Counter(r.doc_id for r in steps[4].select("doc_id").collect())
    for r in mixing.mix(steps[3]).collect():
        assert counts[r.doc_id] == r.taken // max(1, r.size) or r.size == 0


def test_pieces_stage(steps):
    texts = {r.doc_id: r.text for r in steps[4].select("doc_id", "text").collect()}
    m = pieces.PieceModel.load(pieces.default_model())
    rows = steps[5].collect()
    assert len(rows) == steps[4].count() and all(r.exact for r in rows)
    for r in rows[:200]:
        assert m.decode(np.array(r.ids, "<u4")) == texts[r.doc_id]


def test_run_and_reruns_agree(spark):
    sf = str(DATA / "sf0.001")
    a, b = (Counter((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()) for _ in range(2))
    assert a == b and a
