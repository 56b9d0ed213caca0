"""What the index finds for a query is what comparing it with every document finds."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import index, rank
from tessera.plans import catalog
from tessera.plans import search as S

R = catalog.retrieval

ASKED = [(1, "the of blent"), (2, "La de Größe the the"), (3, "zzzabsent"), (4, "file 12"), (5, "src3 external"), (6, "ing"), (7, "…"), (8, ""), (9, "ß über"), (10, "de la"), (11, "none"), (12, "and, that")]


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, query string")


def test_candidates_lose_nothing(spark, sf_dir):
    ix, q = R.search_index(spark, sf_dir), asked(spark)
    docs = R.searchable(spark, sf_dir).withColumn("_t", T.terms("title")).withColumn("_h", T.terms(F.array_join("headings", " ")))
    run = F.greatest(T.prefix_run_of(F.col("_t"), F.col("_words")), T.prefix_run_of(F.col("_h"), F.col("_words")))
    every = S.pairs(q, docs).withColumn("file", rank.exact_file_score()).withColumn("score", rank.title_score())
    every = every.withColumn("place", F.round(F.col("file") + run + rank.folder_prior(F.col("query"), F.col("path")), 9)).where("place > 0 OR score > 0")
    columns = ("query_id", "seq", "cluster", "file", "score", "place")
    expected = sorted(map(tuple, every.select(*columns).collect()))
    assert sorted(map(tuple, S.matches(q, ix).select(*columns).collect())) == expected and len(expected) > 100


def test_snippets_lose_nothing(spark, sf_dir):
    q = asked(spark)
    pairs = R.searchable(spark, sf_dir).crossJoin(q).select("query_id", "seq", T.snippet(F.col("content"), F.col("query")).alias("snippet"))
    expected = sorted(map(tuple, pairs.where(F.length("snippet") > 0).collect()))
    found = S.snippets(q, R.search_index(spark, sf_dir)).select("query_id", "seq", "snippet")
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 100


def test_postings_score_like_a_scan(spark, sf_dir):
    q = asked(spark)
    scan = index.bm25_top(S.indexed(R.searchable(spark, sf_dir)), q, "seq", "indexed", 10)
    expected = sorted((r.query_id, r["rank"], r.key, round(r.score, 6)) for r in scan.collect())
    found = S.keyword_hits(q, R.search_index(spark, sf_dir), 10).collect()
    assert sorted((r.query_id, r["rank"], r.seq, round(r.score, 6)) for r in found) == expected and expected


def test_no_product_with_documents(spark, sf_dir):
    ix, q = R.search_index(spark, sf_dir), asked(spark)
    products = {}
    for name, df in (("hits", S.keyword_hits(q, ix, 10)), ("snippets", S.snippets(q.where("query_id < 7"), ix))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        products[name] = plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin")
    # The one row of statistics is all that meets every posting of the batch.
    assert products["snippets"] == 0 and products["hits"] <= 2
