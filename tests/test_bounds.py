"""What a task holds or reads is bounded, whatever the size of a table."""

import glob

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import udf
from tessera.functions import vectors as V
from tessera.operators import index, ingest, rank
from tessera.plans import catalog
from tessera.plans import search as S

R = catalog.retrieval


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashing_forgets_without_a_trace(monkeypatch):
    texts = ["", "a", "the of blent", "a   b", "größe über", "😀😀 x 😀", *("".join(chr(0x4E00 + 40 * i + j) for j in range(40)) for i in range(150)), "the of blent"]
    alone = np.concatenate([V._Hasher(64).sums([t]) for t in texts])
    hasher = V._Hasher(64)
    assert (hasher.sums(texts) == alone).all()  # more characters than a task numbers
    monkeypatch.setattr(V, "MEMORY", 30)
    parts = [hasher.sums(texts[i : i + 9]) for i in range(0, len(texts), 9)]
    assert (np.concatenate(parts) == alone).all() and len(hasher.runs) < 2000


def test_texts_are_read_in_small_parts():
    texts = ["x"] * 600 + ["y" * (3 << 20)] + ["z" * (1 << 19)] * 5 + [None]
    parts = list(udf.pieces(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), 0))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(len(p) <= udf.TEXTS and (len(p) == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= udf.BYTES) for p in parts)


@pytest.mark.parametrize("name", ["split_sentences", "note_chunks", "chunk_markdown", "heading_sections"])
def test_no_batch_of_whole_results(spark, sf_dir, name):
    assert "ArrowEvalPython" not in plan_of(catalog.QUERIES[name](spark, sf_dir))


def test_buckets_of_postings_are_cut(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        ix = S.built(R.corpus(spark, sf_dir), str(tmp_path / "ix"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(len(glob.glob(f"{d}/*.parquet")) for d in glob.glob(str(tmp_path / "ix/postings/bucket=*"))) > 1
    scan = index.tokenised(S.indexed(R.searchable(spark, sf_dir)), "seq", "indexed").agg(F.count("*"), F.sum("length")).first()
    assert tuple(ix.stats.first()) == tuple(scan)


def test_tokens_are_counted_without_a_shuffle(spark, sf_dir):
    assert "Exchange" not in plan_of(index.postings(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))


def test_vectors_need_no_join_with_documents(spark, sf_dir):
    assert "store" in R.corpus(spark, sf_dir).embedded().vectors.columns


def test_no_task_reads_all_of_a_query(spark):
    pairs = spark.createDataFrame([(1, "a", 5.0), (1, "a", 1.0), (1, "b", 4.0), (1, None, 5.0), (2, "a", 2.0), (2, None, 0.0)], "query_id int, cluster string, file double")
    kept = rank.exact_file_filter(pairs, "query_id", "file", "cluster")
    assert sorted(map(str, kept.collect())) == sorted(map(str, pairs.where("cluster IS NULL OR cluster = 'a'").collect()))
    assert "Window" not in plan_of(kept)
    found = spark.createDataFrame([(1, 7, "u7", 1, 3, "fused", 0.5)], "query_id int, seq long, uri string, rank int, tier int, method string, confidence double")
    hits = spark.createDataFrame([(1, i, f"u{i}") for i in range(1, 10)], "query_id int, seq long, uri string")
    more = S._augment(found, hits, 4)
    assert [(r.seq, r["rank"]) for r in more.orderBy("rank").collect()] == [(7, 1), (1, 2), (2, 3), (3, 4)]
    assert "WindowGroupLimit" in plan_of(more)


def test_resolution_sends_on_two_clusters(spark, sf_dir):
    scored = S.pairs(R.asked(spark, R._EXACT_ASKED), R.searchable(spark, sf_dir)).withColumn("score", rank.title_score()).withColumn("arb", rank.arbitration(F.col("score")))
    plan = plan_of(rank.resolved(scored))
    assert plan.count("WindowGroupLimit") >= 4


def test_many_documents_of_one_content(spark):
    columns = "seq long, store string, uri string, path string, fingerprint string, aliases array<string>"
    rows = [(i, "s", f"u{i}", f"/p{i}", "f", [f"n{i % 3}"]) for i in range(3000)]
    df = ingest.duplicates_of_existing(spark.createDataFrame(rows[1:], columns), spark.createDataFrame(rows[:1], columns))
    assert "Pandas" not in plan_of(df)
    assert {(r.uri, r.duplicate_of) for r in df.collect()} == {(f"u{i}", f"u{i % 3}") for i in range(3, 3000)}


@pytest.mark.parametrize("name", ["exact_file_score", "keyword_snippet", "semantic_excerpt", "title_score"])
def test_documents_are_read_once_for_all_queries(spark, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # below the documents, as at size
    try:
        assert "CartesianProduct" not in plan_of(catalog.QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
