"""Blocks lie and travel in small rows, and scores don't depend on their size."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.llm import hmm


def texts(spark, n, size, vocabulary):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, " ".join(f"w{j}" for j in rng.integers(0, vocabulary, size))) for i in range(n)], "doc_id long, text string").coalesce(1)


def test_no_cell_of_a_block_is_large(spark):
    words = hmm.tokenised(texts(spark, 40, 25_000, 50_000))
    assert words.select("block").distinct().count() == 1
    binary = [f.name for f in words.schema if f.dataType.simpleString() == "binary"]
    assert max(words.agg(*(F.max(F.length(c)) for c in binary)).first()) < 1 << 19


def test_counts_and_sums_lie_uncompressed_and_come_in_small_batches(spark):
    m, _ = hmm.train(hmm.tokenised(texts(spark, 4, 1000, 500)), states=2, iterations=1)
    files = [f.removeprefix("file://") for f in m.sums.inputFiles()]
    meta = [pq.read_metadata(f).row_group(0) for f in files if pq.read_metadata(f).num_row_groups]
    assert meta and {g.column(i).compression for g in meta for i in range(g.num_columns)} == {"UNCOMPRESSED"}
    table = pa.table({"x": [bytes(300_000)] * 25})
    cut = hmm._cut(table)
    assert cut.equals(table) and max(b.nbytes for b in cut.to_batches()) <= hmm.BATCH
    assert hmm._cut(table.slice(0, 0)).schema == table.schema


def test_scores_do_not_depend_on_the_rows(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, "a b"), (-1, None), (-2, "..."), (-3, "")], docs.schema)).repartition(2, "doc_id")
    found = []
    for size in (hmm.SLICE, 50):
        monkeypatch.setattr(hmm, "SLICE", size)
        found.append(sorted(map(str, hmm.language_model_scores(docs, states=3, iterations=2).collect())))
        pieces = hmm.tokenised(docs).agg(F.max("piece")).first()[0]
    assert pieces > 100 and found[0] == found[1] and len(found[0]) == docs.count()


def test_tables_without_a_word(spark):
    docs = spark.createDataFrame([(1, None), (2, "..."), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, hmm.language_model_scores(docs).collect())) == [(i, 0, 0.0, None) for i in (1, 2, 3)]
    assert hmm.language_model_scores(docs.limit(0)).count() == 0
