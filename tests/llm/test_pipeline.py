"""The pipeline: its stages in order, their columns, and its rows against the operators one by one."""

import hashlib
import os
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from tessel.llm import decontamination, piece_encoding, pipeline
from tessel.llm.common import shared_dir
from tests.llm.test_exact import linked

MID = "/root/testdata/sf0.01"


def test_registered():
    have = __spark_entry__.queries()
    assert "pipeline" in have and all(sum(k.startswith(f"op{n}_") for k in have) == 1 for n in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontaminate", "encode"]


def test_stages_keep_columns_and_decide(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{MID}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, MID).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.schema == before.schema
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
        kept.append((before, docs))
    # Of the groups that brute force finds, the smallest doc_id stays, and nothing else goes.
    before, after = kept[2]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    want = sorted(i for i, n, c in linked(rows, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT) if n == 0 or i == c)
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == want and len(want) < len(rows)
    # No benchmark item is found in what the next stage keeps.
    before, after = kept[3]
    assert after.count() < before.count()
    assert decontamination.contaminated(after, spark.read.parquet(f"{MID}/benchmark.parquet")).isEmpty()
    # Clean documents stay.
    labels = spark.read.parquet(f"{MID}/labels.parquet").where("quality = 1")
    for before, after in kept[:2]:
        good = before.join(labels, "doc_id", "left_semi")
        assert good.join(after, "doc_id", "left_semi").count() >= 0.97 * good.count()


def test_last_stage_encodes(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.default_model())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(got) < len(docs)
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(sp.encode(docs[r.doc_id], add_bos=True, add_eos=True)).encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.n_tokens * 4 == len(r.ids)


def test_odd_and_empty_tables(spark, odd, empty):
    assert corpus_pipeline.run(spark, odd).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_extra_columns_pass_through(spark, odd, k):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert corpus_pipeline.STAGES[k][1](spark, docs, odd).columns == docs.columns


def test_near_duplicates_keeps_one_row_of_each_group(spark):
    one, two = "the first of the two texts has these words and no others in it", "quite another text stands here that shares nothing with what is above"
    three = "a third one without any name that is there two times in equal rows"
    rows = [(8, one), (8, two), (9, two), (None, one), (None, three), (None, three), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row_key string")
    got = pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, [(8, one), (8, two), (None, three), (5, ""), (6, None)]))


def test_near_duplicates_writes_few_files(spark, sf):
    """Tables between its steps have no file for each task that worked them out."""
    folder = os.path.dirname(shared_dir(spark))
    parts = lambda: Counter(d for d, _, names in os.walk(folder) for n in names if n.startswith("part-"))
    usual = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    before, docs = set(parts()), spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, sf).collect())
    usually, before = [n for d, n in parts().items() if d not in before], set(parts())
    for k, v in zip(usual, ("64", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        got = sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, sf).collect())
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    dealt = [n for d, n in parts().items() if d not in before]
    assert got == want and 0 < len(got) < docs.count()
    assert len(dealt) == len(usually) > 5 and max(dealt) <= 4 * spark.sparkContext.defaultParallelism


def test_encoding_leaves_no_remembered_parts_in_workers(spark, sf):
    def remembered(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(piece_encoding.codec(piece_encoding.default_model()).known)], pa.int64())})

    piece_encoding.encode_documents(spark.read.parquet(f"{sf}/documents.parquet").repartition(4)).write.format("noop").mode("overwrite").save()
    assert {r.n for r in spark.range(0, 4, 1, 4).mapInArrow(remembered, "n long").collect()} == {0}
