"""The pipeline against the plain version of every stage, and its odd tables."""

import hashlib
import os

import corpus_pipeline
from tests.llm.test_corpus_operators import plain_classes, plain_lines
from leadlens.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(llm, rows):
    return llm.createDataFrame([r[:5] for r in rows], COLUMNS)


def test_stages_by_brute_force(llm, rows):
    docs = table(llm, [r for r in rows if r[0] is not None])
    refs = divergence.references(docs)
    kept = {r.doc_id for r in divergence.judge(docs, refs).where("kept").collect()}
    one = corpus_pipeline.quality(llm, docs, "").collect()
    assert {r.doc_id for r in one} == kept and len(one) == sum(r[0] in kept for r in rows)
    two = corpus_pipeline.lines(llm, llm.createDataFrame(one, COLUMNS), "").collect()
    want = {d: t for (d, old), (_, gone, t) in plain_lines([tuple(r) for r in one]).items() if not gone or t.split()}
    assert {r.doc_id: r.text for r in two} == want and all(r.n_chars == len(r.text) for r in two)
    three = corpus_pipeline.near_copies(llm, llm.createDataFrame(two, COLUMNS), "").collect()
    label = plain_classes({r.doc_id: r.text.encode() for r in two})
    assert {r.doc_id for r in three} == set(label.values())
    four = corpus_pipeline.mix(llm, llm.createDataFrame(three, COLUMNS), "").collect()
    assert {r.doc_id for r in four} <= {r.doc_id for r in three}
    five = corpus_pipeline.encode(llm, llm.createDataFrame(four, COLUMNS), "").collect()
    text = {r.doc_id: r.text for r in three}
    assert sorted(r.doc_id for r in five) == sorted(r.doc_id for r in four)
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in five)


def test_run_equals_its_stages(llm, rows, tmp_path):
    table(llm, rows).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = corpus_pipeline.run(llm, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 5


def test_odd_tables(llm, rows):
    for docs in (table(llm, rows), table(llm, []), table(llm, [(None,) * 5] * 3), table(llm, rows).withColumn("turn", corpus_pipeline.F.lit(1))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(llm, docs, "")
            assert out.columns == docs.columns, name
            out.count()
