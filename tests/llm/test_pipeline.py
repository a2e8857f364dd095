"""The pipeline, stage by stage, against plain Python on what the stage before kept."""

import hashlib

import pytest

import corpus_pipeline as P
from corpusmill.llm import byte_bpe, decontaminate, pii, quality_trees
from corpusmill.session import cut
from tests.llm import fixtures
from tests.llm.test_simhash import slow_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(cut(stage(spark, out[-1], SF), name))
    return [d.toPandas().sort_values("doc_id").reset_index(drop=True) for d in out]


def test_columns(steps):
    assert all(list(d.columns) == list(steps[0].columns) for d in steps[:5])


def test_quality(spark, steps):
    model = quality_trees.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    import numpy as np

    keep = model.score(np.array([quality_trees.statistics(t) for t in steps[0].text])) >= 0.7
    assert steps[0][keep].doc_id.tolist() == steps[1].doc_id.tolist() and 0 < len(steps[1]) < len(steps[0])


def test_near_duplicates(steps):
    low, _ = slow_groups(steps[1].text.tolist())
    assert steps[2].doc_id.tolist() == steps[1].doc_id[sorted(set(low))].tolist()


def test_decontamination(spark, steps):
    items = [t for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    leaky = [any(i in t for i in items) for t in steps[2].text]
    assert any(leaky)
    gone = set(steps[2].doc_id) - set(steps[3].doc_id)
    assert set(steps[2].doc_id[leaky]) <= gone and len(gone) <= sum(leaky) + 2


def test_personal_data(steps):
    assert steps[4].doc_id.tolist() == steps[3].doc_id.tolist()
    assert not any(pii.emails(t) for t in steps[4].text)
    clean = [not pii.base_spans(t) and not pii.secret_spans(t, []) for t in steps[3].text]
    assert steps[4].text[clean].tolist() == steps[3].text[clean].tolist() and (steps[4].n_chars == steps[4].text.str.len()).all()


def test_tokens(steps):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        coder = byte_bpe.ByteBPE(f.read(), public_tokenizers.PATTERN)
    for text, n, ids, digest in zip(steps[4].text, steps[5].n_tokens, steps[5].ids, steps[5].decoded_sha256):
        assert coder.decode(list(ids)) == text and n == len(ids) and digest == hashlib.sha256(text.encode()).hexdigest()


def test_run_is_the_stages(spark, steps):
    assert sorted((r["doc_id"], r["n_tokens"]) for r in P.run(spark, SF).collect()) == list(zip(steps[5].doc_id, steps[5].n_tokens))


def test_tables_go_with_their_scope(spark):
    """The shared folder holds nothing more after the queries that write tables, and after the pipeline."""
    import glob

    from corpusmill.llm import queries
    from corpusmill.session import scope, shared_dir

    held = lambda: set(glob.glob(shared_dir(spark).removeprefix("file:").replace("//", "/", 1) + "/corpusmill-*"))
    before = held()
    for name in ("op6_benchmark_leaks", "op7_suffix_dedup", "op8_pii", "op10_simhash_dedup"):
        with scope(spark):
            queries.QUERIES[name](spark, SF).count()
            assert held() - before, name
        assert held() == before, name
    with scope(spark):
        P.run(spark, SF).count()
    assert held() == before


def test_awkward_documents(spark):
    docs = cut(fixtures.documents(spark))
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, SF), name)
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert decontaminate.PASSAGE == 64


def test_stages_by_themselves_bound_their_batches(spark):
    """Each of STAGES, called without run(), sets the bound of batches to Python workers, unless the session has its own."""
    from corpusmill.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.getAll.get(key)
    for own in (None, "123456"):
        for name, stage in P.STAGES:
            spark.conf.set(key, own) if own else spark.conf.unset(key)
            with pytest.raises(Exception):  # noqa: B017  no documents
                stage(spark, None, SF)
            assert spark.conf.getAll.get(key) == (own or str(BATCH_BYTES)), name
    spark.conf.set(key, before) if before else spark.conf.unset(key)
