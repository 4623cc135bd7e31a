"""The pipeline's stages on planted cases."""

import hashlib
import os

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    first = source.filter("length(text) > 900").orderBy("doc_id").first()
    near = first.text.replace(" ", "  ", 3)
    add = [(9001, near, "en", "s", 1), (9002, item, "en", "s", 1), (9003, "12 34 !!", "en", "s", 1), (9004, None, None, None, None)]
    docs = source.unionAll(spark.createDataFrame(add, source.schema))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}-{os.getpid()}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not {9003, 9004} & kept[0] and {9001, 9002} <= kept[0]
    assert 9001 not in kept[2] and first.doc_id in kept[2]
    assert 9002 not in kept[3]
    assert kept[3] == kept[4] and len(kept[4]) > 150
    assert "ids_sha256" in docs.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_run_against_brute_force(spark, tmp_path):
    """The whole run against plain versions of its stages; of the language stage, whose
    model is learned, what it keeps is taken as it is and checked by its rule."""
    from hashloom.llm.langid import fit, held_out, identify
    from test_operators import components_by_force, contamination_by_force, lines_by_force
    from tokenizers import Tokenizer

    source = spark.read.parquet(f"{SF}/documents.parquet")
    first = source.filter("length(text) > 900").orderBy("doc_id").first().text
    add = [(9001, first.replace(" ", "  ", 3), "en", "s", 1), (9002, "12 34 !!", "en", "s", 1), (9003, None, None, None, None), (9004, first + "\nmore words here", None, None, 1)]
    source.unionAll(spark.createDataFrame(add, source.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    found = identify(docs.select("doc_id", "text"), fit(docs.filter(~held_out())), keep_text=True).collect()
    texts = {r.doc_id: r.text for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_SCORE}
    assert len(texts) > 0.9 * len(found) and not {9002, 9003} & set(texts)
    cut = lines_by_force(sorted(texts.items()))
    texts = {i: t for i, (t, gone) in cut.items() if gone < texts[i].count("\n") + 1}
    groups = components_by_force(texts, 5, (80, 100))
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {i: contamination_by_force(t, items) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    want = {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in want.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_batches_of_stages_called_alone(spark, tmp_path, monkeypatch):
    """A stage's frame is sent to Python in small batches also where not run() runs it."""
    from hashloom.llm import bpe

    def sizes(model, text_col, with_ids):
        import pyarrow as pa

        def run(batches):
            for b in batches:
                one = pa.array([b.column(text_col).nbytes])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(0, 1) for c in b.schema.names if c != text_col), one, pa.array([""]), pa.array([""])], names=[*(c for c in b.schema.names if c != text_col), "n_tokens", "ids_sha256", "decoded_sha256"])

        return run

    monkeypatch.setattr(bpe, "_run", sizes)
    before = spark.conf.get(corpus_pipeline.BATCH_KEY)
    spark.sql("select id as doc_id, repeat('some words ', 10000) as text, 'en' as lang, 's' as source, 110000L as n_chars from range(0, 90, 1, 1)").write.parquet(f"{tmp_path}/documents.parquet")
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1)
        held = [r.n_tokens for r in corpus_pipeline.encode(spark, docs, str(tmp_path)).select("n_tokens").collect()]
    finally:
        spark.conf.set(corpus_pipeline.BATCH_KEY, before)
    assert sum(held) >= 90 * 110_000 and max(held) < 3 << 20


def test_one_python_worker_for_a_task(spark, monkeypatch):
    """No frame that the near duplicates write has two Python nodes, which would run in one
    task, with a worker for each."""
    import re

    from hashloom.llm import jaccard

    plans = {}

    def spied(df, label, inner=jaccard.written):
        plans.setdefault(label, []).append(len(re.findall(r"MapInArrow|ArrowEvalPython", df._jdf.queryExecution().executedPlan().toString())))
        return inner(df, label)

    monkeypatch.setattr(jaccard, "written", spied)
    text = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame([(k, f"{text} end{k}") for k in range(6)] + [(9, "other words of another text here")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 9}
    assert plans["may"] and max(max(n) for n in plans.values()) == 1
