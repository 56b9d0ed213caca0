"""Catalogue: search, ranking and vectors over documents, benchmark and embeddings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import index, knn, learner, rank
from . import search as S
from .catalog import query, table
from .stored import settled, spread

ASKED = ((1, "the of blent"), (2, "La de Größe the the"), (3, "zzzabsent"), (4, "and that reing thing"))
_Q = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") AS q(query_id, query)"
_BATCH = "(SELECT CAST(item_id AS BIGINT) AS query_id, array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ') AS query FROM benchmark)"


def asked(spark: SparkSession, pairs=ASKED) -> DataFrame:
    """A local table, whose size Spark knows: one made of Python rows would be met by a product that reads the documents once for each core."""
    ids, queries = zip(*pairs)
    return spark.createDataFrame(pa.table({"query_id": pa.array(map(int, ids), pa.int32()), "query": pa.array(queries, pa.string())}), "query_id int, query string")


def asked_of_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("query"))


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9가-힣]+')"


def uniq(x: str) -> str:
    return f"list_transform([{x}], lambda l: list_filter(l, lambda u, i: list_position(l, u) = i))[1]"


def _bm25_sql(text: str, queries: str, k: int, source: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id AS key, {tok(text)} AS t FROM {source}),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT key, dl, token, count(*) AS tf FROM (SELECT key, len(t) AS dl, unnest(t) AS token FROM d) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
q AS (SELECT query_id, unnest({tok('query')}) AS token FROM {queries}),
s AS (SELECT query_id, key, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN tf USING (token) JOIN df USING (token), stats GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank FROM s)
SELECT query_id, key AS doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(_bm25_sql("text", _Q, 10))
def bm25_topk(spark, sf_dir):
    return _ranked(index.bm25_top(spread(table(spark, sf_dir, "documents")), asked(spark), "doc_id", "text", 10))


@query(_bm25_sql("text", _BATCH, 10))
def bm25_topk_batch(spark, sf_dir):
    return _ranked(index.bm25_top(spread(table(spark, sf_dir, "documents")), asked_of_benchmark(spark, sf_dir), "doc_id", "text", 10))


#: documents as search sees them: title of the first three words, one heading, one tag, one link, a path in a folder.
_WORDS = "string_split(text, ' ')"
_DOC_SQL = f"""(SELECT doc_id, doc_id AS seq, source AS store, concat('local://', source, '/doc', doc_id) AS uri, array_to_string(list_slice({_WORDS}, 1, 3), ' ') AS title, text AS content,
  [coalesce({_WORDS}[5], 'none')] AS headings, [concat('alias ', doc_id)] AS aliases, [lang] AS tags, [concat('note ', source)] AS links,
  concat('/', CASE WHEN doc_id % 7 = 0 THEN 'external' ELSE 'main' END, '/', source, '/', lang, '/file ', doc_id // 2, '.md') AS path FROM documents)"""


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    folder = F.when(F.col("doc_id") % 7 == 0, "external").otherwise("main")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("doc_id").alias("seq"),
        F.col("source").alias("store"),
        F.concat(F.lit("local://"), "source", F.lit("/doc"), "doc_id").alias("uri"),
        F.array_join(F.slice(words, 1, 3), " ").alias("title"),
        F.col("text").alias("content"),
        F.array(F.coalesce(F.get(words, F.lit(4)), F.lit("none"))).alias("headings"),
        F.array(F.concat(F.lit("alias "), "doc_id")).alias("aliases"),
        F.array("lang").alias("tags"),
        F.array(F.concat(F.lit("note "), "source")).alias("links"),
        F.concat(F.lit("/"), folder, F.lit("/"), "source", F.lit("/"), "lang", F.lit("/file "), F.floor(F.col("doc_id") / 2), F.lit(".md")).alias("path"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("context"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> S.Corpus:
    return S.Corpus(searchable(spark, sf_dir).drop("doc_id"))


_BUILT: dict[tuple[str, str], S.Index] = {}


def search_index(spark: SparkSession, sf_dir: str) -> S.Index:
    """The index of documents with vectors, built once in a session and then read by every search."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = S.built(corpus(spark, sf_dir).embedded())
    return _BUILT[key]


_FIELDED = f"(SELECT doc_id, concat_ws(chr(10), title, title, title, headings[1], headings[1], aliases[1], tags[1], links[1], concat('[Headings] ', headings[1], chr(10), chr(10), '[Passage]', chr(10), content)) AS text FROM {_DOC_SQL})"


@query(f"SELECT count(*) AS n, CAST(sum(len({tok('text')})) AS BIGINT) AS words, count(*) AS n_vectors FROM {_FIELDED}")
def index_build(spark, sf_dir):
    """Writes the index anew; its statistics."""
    _BUILT.pop((spark.sparkContext.applicationId, sf_dir), None)
    ix = search_index(spark, sf_dir)
    return ix.stats.crossJoin(ix.vectors.agg(F.count("*").alias("n_vectors"))).select("n", "words", "n_vectors")


@query(_bm25_sql("text", _Q, 10, _FIELDED))
def bm25_fielded(spark, sf_dir):
    return _ranked(index.bm25_top(S.indexed(searchable(spark, sf_dir)), asked(spark), "doc_id", "indexed", 10))


@query(f"""WITH tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS token FROM documents) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, token, tf, df, round(tf * ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS weight FROM tf JOIN df USING (token), n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) AS rank FROM s)
SELECT doc_id, token, tf, df, weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def tf_idf_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tf = index.postings(spread(docs), "doc_id", "text").withColumnRenamed("key", "doc_id")
    # Written out, the vocabulary is of a known size: where it is small it goes to the postings, which then stay where they are.
    joined = tf.join(settled(index.document_frequencies(tf), "frequencies"), "token").crossJoin(docs.agg(F.count("*").alias("n")))
    weighted = joined.withColumn("weight", F.round(F.col("tf") * index.idf(F.col("n"), F.col("df")), 6))
    return index.top(weighted, 3, ["doc_id"], F.col("weight").desc(), F.col("token")).select("doc_id", "token", "tf", "df", "weight", "rank")


@query(f"SELECT doc_id, CAST(len({tok('text')}) AS BIGINT) AS length, CAST(len(list_distinct({tok('text')})) AS BIGINT) AS n_terms FROM documents")
def doc_stats(spark, sf_dir):
    rows = index.tokenised(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select(F.col("key").alias("doc_id"), "length", F.size(F.array_distinct("tokens")).cast("long").alias("n_terms"))


@query(f"SELECT count(*) AS n, round(avg(len({tok('text')})), 6) AS avgdl FROM documents")
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(table(spark, sf_dir, "documents"), "doc_id", "text").select("n", F.round("avgdl", 6).alias("avgdl"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the of')")
def substring_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("the of"))).select("doc_id")


@query("SELECT doc_id, CAST(len(list_filter(['the', 'blent', 'de'], lambda t: contains(lower(text), t))) AS INTEGER) AS hits FROM documents")
def term_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.term_hits(F.col("text"), T.terms(F.lit("the blent de the"))).alias("hits"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'der') AND contains(lower(text), 'und')")
def contains_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.contains_all(F.col("text"), T.terms(F.lit("Der und")))).select("doc_id")


_RUN = """list_max(list_transform(range(len(o)), lambda s: coalesce(nullif(list_position(list_transform(range(len(w)), lambda j: s + j < len(o) AND starts_with(o[s + j + 1], w[j + 1])), false), 0) - 1, len(w))))"""


@query(f"""WITH p AS (SELECT doc_id, query_id, {uniq(tok('title'))} AS o, {uniq(tok('query'))} AS w FROM {_DOC_SQL}, {_Q})
SELECT doc_id, query_id, CASE WHEN len(o) = 0 OR len(w) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST({_RUN} AS DOUBLE) / len(w), 6) END AS run FROM p""")
def prefix_run_score(spark, sf_dir):
    pairs = searchable(spark, sf_dir).crossJoin(asked(spark))
    return pairs.select("doc_id", "query_id", F.round(T.prefix_run(F.col("title"), T.terms("query")), 6).alias("run"))


_BOOST_SQL = f"""CASE WHEN len(w) = 0 THEN 0 ELSE
  CASE WHEN contains(lower(title), q) THEN 4.0 ELSE 0 END + CASE WHEN contains(lower(headings[1]), q) THEN 2.5 ELSE 0 END
  + 0.75 * len(list_filter(w, lambda t: contains(lower(title), t))) + 0.35 * len(list_filter(w, lambda t: contains(lower(headings[1]), t)))
  + 0.2 * len(list_filter(w, lambda t: contains(lower(tags[1]), t))) + 0.15 * len(list_filter(w, lambda t: contains(lower(links[1]), t))) END"""
_PAIRS_SQL = f"(SELECT d.*, query_id, lower(trim(query)) AS q, {uniq(tok('query'))} AS w FROM {_DOC_SQL} d, {_Q})"


@query(f"SELECT doc_id, query_id, round(CAST({_BOOST_SQL} AS DOUBLE), 6) AS boost FROM {_PAIRS_SQL} WHERE {_BOOST_SQL} > 0")
def lexical_boost(spark, sf_dir):
    c = F.col
    pairs = searchable(spark, sf_dir).crossJoin(asked(spark))
    out = pairs.select("doc_id", "query_id", F.round(rank.lexical_boost(c("query"), c("title"), c("headings"), c("tags"), c("links")), 6).alias("boost"))
    return out.where("boost > 0")


_FOLDERS = ((1, "src1 de"), (2, "main src12 en"), (3, "external"), (4, "nothing here"))
_FQ = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in _FOLDERS) + ") AS q(query_id, query)"
_FOLDER = "trim(regexp_replace(regexp_replace(path, '[^/]*$', ''), '/+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT doc_id, query_id, {_FOLDER} AS folder, {uniq(tok('query'))} AS w FROM {_DOC_SQL}, {_FQ})
SELECT doc_id, query_id, round(CAST(0.12 * len(list_filter(w, lambda t: contains(lower(folder), t))) + CASE WHEN contains(array_to_string({uniq(tok('folder'))}, ' '), array_to_string(w, ' ')) THEN 0.35 ELSE 0 END AS DOUBLE), 6) AS prior FROM p""")
def folder_prior(spark, sf_dir):
    pairs = searchable(spark, sf_dir).crossJoin(asked(spark, _FOLDERS))
    return pairs.select("doc_id", "query_id", F.round(rank.folder_prior(F.col("query"), F.col("path")), 6).alias("prior"))


@query(f"SELECT doc_id, query_id, CASE WHEN contains(lower(path), 'external') AND NOT contains(lower(title), lower(query)) THEN CAST(0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS penalty FROM {_DOC_SQL}, (VALUES (1, 'the'), (2, 'un')) AS q(query_id, query)")
def external_penalty(spark, sf_dir):
    pairs = searchable(spark, sf_dir).crossJoin(asked(spark, ((1, "the"), (2, "un"))))
    return pairs.select("doc_id", "query_id", rank.external_penalty(F.col("query"), F.col("title"), F.col("path")).alias("penalty"))


_EXACT_ASKED = ((1, "file 12"), (2, "alias 77"), (3, "the and"), (4, "de la"))
_EQ = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in _EXACT_ASKED) + ") AS q(query_id, query)"


def _lookup(x: str) -> str:
    return f"array_to_string({uniq(tok(x))}, ' ')"


_EXACT_SQL = f"""WITH p AS (SELECT doc_id, query_id, path, {_lookup('query')} AS q, {uniq(tok('query'))} AS w,
  {_lookup("concat_ws(' ', title, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[.][^.]*$', ''), aliases[1])")} AS n, {_lookup('headings[1]')} AS h, {_lookup('substr(content, 1, 2000)')} AS b FROM {_DOC_SQL}, {_EQ}),
s AS (SELECT doc_id, query_id, path, CASE WHEN length(q) < 4 THEN 0 WHEN contains(n, q) THEN 5 WHEN len(list_filter(w, lambda t: contains(n, t))) = len(w) THEN 4.5
  WHEN contains(h, q) THEN 4 WHEN len(list_filter(w, lambda t: contains(h, t))) = len(w) AND h <> '' THEN 3.5 WHEN contains(b, q) THEN 3 ELSE 0 END AS score FROM p)"""


@query(_EXACT_SQL + " SELECT doc_id, query_id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0")
def exact_file_score(spark, sf_dir):
    pairs = S.pairs(asked(spark, _EXACT_ASKED), searchable(spark, sf_dir))
    return pairs.select("doc_id", "query_id", rank.exact_file_score().alias("score")).where("score > 0")


@query(_EXACT_SQL + """, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s)
SELECT doc_id, query_id FROM m WHERE best < 3 OR (query_id, lower(path)) IN (SELECT (query_id, lower(path)) FROM m WHERE score >= best)""")
def exact_file_filter(spark, sf_dir):
    scored = S.pairs(asked(spark, _EXACT_ASKED), searchable(spark, sf_dir)).select("doc_id", "query_id", "cluster", rank.exact_file_score().alias("file"))
    return rank.exact_file_filter(settled(scored, "files"), "query_id", "file", "cluster").select("doc_id", "query_id")


_TITLE_SQL = f"""WITH p AS (SELECT doc_id, query_id, {_lookup('query')} AS q, {uniq(tok('query'))} AS w, unnest([title, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[.][^.]*$', ''), aliases[1]]) AS name FROM {_DOC_SQL}, {_EQ}),
n AS (SELECT *, {_lookup('name')} AS n, {uniq(tok('name'))} AS o FROM p),
s AS (SELECT doc_id, query_id, max(CASE WHEN length(q) < 4 OR n = '' THEN 0 ELSE CASE WHEN n = q THEN 7 WHEN contains(n, q) THEN 6 WHEN len(list_filter(w, lambda t: contains(n, t))) = len(w) THEN 5.2 ELSE 0 END
  + CAST(1.2 AS DOUBLE) * {_RUN} / len(w) END) AS score FROM n GROUP BY ALL)
SELECT doc_id, query_id, round(CAST(score AS DOUBLE), 6) AS score FROM s WHERE score > 0"""


@query(_TITLE_SQL)
def title_score(spark, sf_dir):
    pairs = S.pairs(asked(spark, _EXACT_ASKED), searchable(spark, sf_dir))
    return pairs.select("doc_id", "query_id", F.round(rank.title_score(), 6).alias("score")).where("score > 0")


@query()
def exact_note_resolution(spark, sf_dir):
    return S.exact(asked(spark, _EXACT_ASKED), search_index(spark, sf_dir), 5).select("query_id", "uri", "cluster", "rank", "confidence")


@query(f"""WITH b AS ({_bm25_sql('text', _Q, 30)}), j AS (SELECT query_id, doc_id, score, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM b JOIN documents USING (doc_id))
SELECT query_id, doc_id, rank FROM j WHERE n <= 2""")
def cluster_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranked = _ranked(index.bm25_top(docs, asked(spark), "doc_id", "text", 30)).join(docs.select("doc_id", "source"), "doc_id")
    return rank.cap_clusters(ranked, ["query_id"], "source", [F.col("rank")]).select("query_id", "doc_id", "rank")


@query(f"""WITH b AS ({_bm25_sql('text', _Q, 10, _FIELDED)}),
j AS (SELECT query_id, seq, rank, path, score + {_BOOST_SQL} - CASE WHEN contains(lower(path), 'external') AND NOT contains(lower(title), q) THEN 0.6 ELSE 0 END
  + 0.12 * len(list_filter(w, lambda t: contains(lower({_FOLDER}), t))) + CASE WHEN contains({_lookup(_FOLDER)}, array_to_string(w, ' ')) THEN 0.35 ELSE 0 END AS adjusted FROM b JOIN {_PAIRS_SQL} USING (doc_id, query_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(path) ORDER BY round(adjusted, 5) DESC, rank) AS n FROM j)
SELECT query_id, seq AS doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(adjusted, 5) DESC, rank) AS INTEGER) AS rank FROM c WHERE n <= 2""")
def keyword_ranking(spark, sf_dir):
    return S.keyword_ranking(asked(spark), search_index(spark, sf_dir), 10).select("query_id", F.col("seq").alias("doc_id"), "rank")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")


def _probes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


_KNN = "SELECT q.vec_id AS query_id, e.vec_id AS key, {score} AS score FROM embeddings e, embeddings q"
_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_TOP = "SELECT query_id, key, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key DESC) AS rank FROM ({inner})) WHERE rank <= 10"


def _rounded(df):
    return df.select("query_id", "key", F.round("score", 6).alias("score"), "rank")


@query(_TOP.format(inner=_KNN.format(score=_COS)))
def knn_cosine(spark, sf_dir):
    return _rounded(knn.knn(_vectors(spark, sf_dir), _probes(spark, sf_dir)))


@query(_TOP.format(inner=_KNN.format(score=_COS)))
def knn_cosine_join(spark, sf_dir):
    return _rounded(knn.knn_join(_vectors(spark, sf_dir).select("key", "embedding"), _probes(spark, sf_dir)))


@query(_TOP.format(inner=_KNN.format(score="list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))")))
def knn_dot(spark, sf_dir):
    return _rounded(knn.knn(_vectors(spark, sf_dir), _probes(spark, sf_dir), cosine=False))


@query(f"""SELECT query_id, label, key, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 9) DESC, key DESC) AS rank
FROM (SELECT q.vec_id AS query_id, e.label, e.vec_id AS key, {_COS} AS score FROM embeddings e, embeddings q)) WHERE rank <= 3""")
def knn_per_label(spark, sf_dir):
    found = knn.knn(_vectors(spark, sf_dir), _probes(spark, sf_dir), 3, by="label")
    return found.select("query_id", "label", "key", F.round("score", 6).alias("score"), "rank")


@query()
def lsh_knn(spark, sf_dir):
    return _rounded(knn.lsh_knn(_vectors(spark, sf_dir).select("key", "embedding"), _probes(spark, sf_dir)))


_HASH_SQL = """WITH d AS (SELECT doc_id, substr(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), '[^a-z0-9_ .\\-/]', '', 'g'), 1, 512) AS t FROM documents WHERE regexp_matches(text, '^[\\x00-\\x7F]*$')),
w AS (SELECT doc_id, concat('w:', x) AS f, 2.0 AS v FROM (SELECT doc_id, unnest(string_split(t, ' ')) AS x FROM d) WHERE length(x) > 1),
g AS (SELECT doc_id, n, substr(concat(' ', t, ' '), CAST(i AS BIGINT), n) AS x FROM (SELECT doc_id, t, n, unnest(range(1, length(t) + 3)) AS i FROM d, (VALUES (3), (4), (5)) AS s(n))),
f AS (SELECT * FROM w UNION ALL SELECT doc_id, concat('c:', x), 1.0 FROM g WHERE length(x) = n AND trim(x) <> ''),
b AS (SELECT doc_id, CAST(concat('0x', substr(sha256(f), 1, 8)) AS BIGINT) % 384 AS b, sum(CASE WHEN CAST(concat('0x', substr(sha256(f), 9, 8)) AS BIGINT) % 2 = 0 THEN CAST(v AS DOUBLE) ELSE -CAST(v AS DOUBLE) END) AS v FROM f GROUP BY ALL),
s AS (SELECT doc_id, b, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM b)
SELECT doc_id, CAST(b AS INTEGER) AS bucket, round(v, 6) AS value FROM s WHERE v <> 0"""


@query(_HASH_SQL)
def hash_embedding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t")).where(F.col("t").rlike(r"^[\x00-\x7F]*$"))
    rows = V.hashed(docs, "doc_id", "t").select("doc_id", F.posexplode("embedding").alias("bucket", "value"))
    return rows.where("value <> 0").select("doc_id", "bucket", F.round("value", 6).alias("value"))


@query()
def hash_embedding_knn(spark, sf_dir):
    c = corpus(spark, sf_dir).embedded()
    return _rounded(knn.knn(c.vectors.withColumnRenamed("seq", "key"), S.embed_queries(asked(spark)), 5))


_E = "CAST(embedding AS DOUBLE[])"


@query(f"""WITH v AS (SELECT vec_id, {_E} AS e, list_min({_E}) AS low, (list_max({_E}) - list_min({_E})) / 255.0 AS step FROM embeddings)
SELECT vec_id, round(low, 6) AS low, round(step, 9) AS step, CAST(list_sum(list_transform(e, lambda x: least(255, greatest(0, floor((x - low) / step))))) AS BIGINT) AS code_sum FROM v""")
def quantize_vectors(spark, sf_dir):
    q = V.quantise(F.col("embedding").cast("array<double>"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", q.alias("q"))
    total = F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("vec_id", F.round("q.low", 6).alias("low"), F.round("q.step", 9).alias("step"), total.alias("code_sum"))


@query(f"""WITH f AS (SELECT list_min({_E}) AS low, list_max({_E}) AS high FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, CAST(list_sum(list_transform({_E}, lambda x: greatest(-128, least(127, trunc((x - (low + high) / 2) / ((high - low) / 254.0)))))) AS BIGINT) AS code_sum FROM embeddings, f""")
def quantize_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    first = rows.agg(F.min_by("e", "vec_id").alias("f"))
    low, high = F.array_min("f"), F.array_max("f")
    codes = V.grid_codes(F.col("e"), (low + high) / 2, (high - low) / 254.0)
    return rows.crossJoin(first).select("vec_id", F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"))


@query(f"""WITH v AS (SELECT vec_id, {_E} AS e, list_min({_E}) AS low, (list_max({_E}) - list_min({_E})) / 255.0 AS step FROM embeddings),
d AS (SELECT vec_id, e, list_transform(e, lambda x: low + least(255, greatest(0, floor((x - low) / step))) * step) AS r FROM v)
SELECT vec_id, round(list_cosine_similarity(e, r), 5) AS cosine FROM d""")
def quantized_cosine(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.cosine(e, V.dequantise(V.quantise(e))), 5).alias("cosine"))


@query(f"""WITH a AS (SELECT vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, label FROM embeddings),
b AS (SELECT x.vec_id, list_transform(range(1, len(x.embedding) + 1), lambda i: 0.7 * CAST(x.embedding[i] AS DOUBLE) + 0.3 * CAST(y.embedding[i] AS DOUBLE)) AS v FROM a x JOIN a y ON y.n = x.n + 1 AND y.label = x.label)
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM b""")
def multimodal_blend(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id")).alias("picture")).where("picture IS NOT NULL")
    mixed = V.blend(F.col("embedding").cast("array<double>"), F.col("picture").cast("array<double>"), 0.7, 0.3)
    return v.select("vec_id", F.round(F.get(mixed, F.lit(0)), 6).alias("first"), F.round(F.get(mixed, F.lit(63)), 6).alias("last"))


_TWO = f"""WITH l0 AS ({_bm25_sql('text', "(VALUES (1, 'the of blent')) AS q(query_id, query)", 8)}), l1 AS ({_bm25_sql('text', "(VALUES (1, 'and that blent')) AS q(query_id, query)", 8)}),
l AS (SELECT 0 AS list, doc_id, rank FROM l0 UNION ALL SELECT 1, doc_id, rank FROM l1), f AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS rrf FROM l GROUP BY doc_id)"""


def _two_lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lists = [index.bm25_top(docs, asked(spark, ((1, q),)), "doc_id", "text", 8).select("query_id", F.lit(i).alias("list"), F.col("key").alias("id"), "rank") for i, q in enumerate(("the of blent", "and that blent"))]
    return lists[0].unionByName(lists[1])


@query(_TWO + " SELECT doc_id, round(CAST(rrf AS DOUBLE), 6) AS rrf, round(CAST(least(1, rrf / 2) AS DOUBLE), 6) AS score FROM f")
def rrf_fusion(spark, sf_dir):
    fused = rank.reciprocal_rank_fusion(_two_lists(spark, sf_dir))
    return fused.select(F.col("id").alias("doc_id"), F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"))


@query(_TWO + """, o AS (SELECT count(*) FILTER (n = 2) AS shared FROM (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)),
c AS (SELECT round(CAST(least(1, max(rrf) / (2.0 / 61)) AS DOUBLE) * greatest(CAST(0.25 AS DOUBLE), shared / 8.0), 4) AS confidence FROM f, o GROUP BY shared)
SELECT confidence, CASE WHEN confidence > 0.75 THEN 'PASS' WHEN confidence > 0.45 THEN 'FORGE' ELSE 'INHIBIT' END AS verdict FROM c""")
def hybrid_confidence(spark, sf_dir):
    lists = _two_lists(spark, sf_dir)
    shared = lists.groupBy("id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == 2).alias("shared"))
    sides = lists.agg(F.count_if(F.col("list") == 0).alias("l"), F.count_if(F.col("list") == 1).alias("r"))
    raw = rank.reciprocal_rank_fusion(lists).agg(rank.fused_strength(F.max("rrf")).alias("raw"))
    sure = raw.crossJoin(shared).crossJoin(sides).select(rank.confidence(F.col("raw"), F.col("shared"), F.col("l"), F.col("r")).alias("confidence"))
    return sure.select("confidence", rank.verdict(F.col("confidence")).alias("verdict"))


@query("SELECT vec_id, CASE WHEN c > 0.75 THEN 'PASS' WHEN c > 0.45 THEN 'FORGE' ELSE 'INHIBIT' END AS verdict FROM (SELECT vec_id, (vec_id % 101) / 100.0 AS c FROM embeddings)")
def quality_verdict(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", rank.verdict((F.col("vec_id") % 101) / 100.0).alias("verdict"))


_SNIP = """WITH p AS (SELECT doc_id, query_id, text, lower(text) AS t, lower(query) AS q FROM documents, {q}),
a AS (SELECT *, CASE WHEN contains(t, q) THEN q ELSE list_filter(string_split(q, ' '), lambda w: length(w) > 3 AND contains(t, w))[1] END AS word FROM p),
b AS (SELECT *, strpos(t, word) AS pos FROM a WHERE word IS NOT NULL),
c AS (SELECT doc_id, query_id, trim(regexp_replace(substr(text, CAST(greatest(pos - 160, 1) AS BIGINT), CAST(pos + length(word) + 160 - greatest(pos - 160, 1) AS BIGINT)), '\\s+', ' ', 'g')) AS flat FROM b)
SELECT doc_id, query_id, CASE WHEN length(flat) <= 300 THEN flat ELSE concat(rtrim(regexp_extract(substr(flat, 1, 298), '^(.*)\\s', 1)), '...') END AS snippet FROM c"""


@query(_SNIP.format(q=_Q))
def keyword_snippet(spark, sf_dir):
    pairs = spread(table(spark, sf_dir, "documents")).crossJoin(asked(spark))
    return pairs.select("doc_id", "query_id", T.snippet(F.col("text"), F.col("query")).alias("snippet")).where(F.length("snippet") > 0)


@query(f"""WITH s AS (SELECT doc_id, query_id, snippet FROM ({_SNIP.format(q=_Q)})), d AS (SELECT doc_id, query_id, headings, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS flat FROM {_DOC_SQL}, {_Q})
SELECT doc_id, query_id, trim(concat('[', headings[1], '] ', coalesce(nullif(snippet, ''), CASE WHEN length(flat) <= 180 THEN flat ELSE concat(rtrim(regexp_extract(substr(flat, 1, 178), '^(.*)\\s', 1)), '...') END))) AS excerpt FROM d LEFT JOIN s USING (doc_id, query_id)""")
def semantic_excerpt(spark, sf_dir):
    c = F.col
    pairs = searchable(spark, sf_dir).crossJoin(asked(spark))
    return pairs.select("doc_id", "query_id", T.excerpt(c("headings"), c("context"), c("content"), c("query")).alias("excerpt"))


@query(f"""WITH h AS (SELECT DISTINCT query_id, doc_id FROM ({_SNIP.format(q=_Q)})), r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM h WHERE query_id <> 3)
SELECT query_id, CAST(rank AS INTEGER) AS rank, concat('local://', source, '/doc', doc_id) AS uri, CAST(0.7 AS DOUBLE) AS confidence, 'FORGE' AS verdict FROM r JOIN documents USING (doc_id) WHERE rank <= 5""")
def keyword_search(spark, sf_dir):
    found = S.search(asked(spark), search_index(spark, sf_dir), "keyword")
    return found.where("method = 'keyword'").select("query_id", "rank", "uri", "confidence", "verdict")


def _search(mode):
    def run(spark, sf_dir):
        q, ix = asked(spark, (*ASKED, (5, "alias 77"))), search_index(spark, sf_dir)
        embedded = S.embed_with_pictures(q.withColumn("picture", F.when(F.col("query_id") != 4, F.encode("query", "UTF-8")))) if mode == "multimodal" else None
        return S.search(q, ix, mode, embedded=embedded).drop("snippet")

    run.__name__ = f"{mode}_search"
    return query()(run)


semantic_search, hybrid_search, multimodal_search = (_search(m) for m in ("semantic", "hybrid", "multimodal"))


@query()
def lexical_backstop(spark, sf_dir):
    return S.backstop(asked(spark, (*ASKED, (5, "src3 external"))), search_index(spark, sf_dir), 5).select("query_id", "uri", "rank")


@query(f"""WITH h AS (SELECT DISTINCT query_id, doc_id FROM ({_SNIP.format(q=_Q)})),
s AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM h WHERE doc_id % 5 = 0) WHERE rank <= 2),
u AS (SELECT query_id, doc_id, n + row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM h JOIN (SELECT query_id, max(rank) AS n FROM s GROUP BY query_id) USING (query_id) ANTI JOIN s USING (query_id, doc_id)),
a AS (SELECT *, 'fused' AS method FROM s UNION ALL SELECT *, 'augmented' FROM u WHERE rank <= 5)
SELECT query_id, CAST(rank AS INTEGER) AS rank, concat('local://', source, '/doc', doc_id) AS uri, method FROM a JOIN documents USING (doc_id)""")
def forge_augment(spark, sf_dir):
    hits = settled(S.snippets(asked(spark), search_index(spark, sf_dir)).select("query_id", "seq", "uri"), "hits")
    some = hits.where("seq % 5 = 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))).where("rank <= 2")
    found = some.select("query_id", "seq", "uri", "rank", F.lit(3).alias("tier"), F.lit("fused").alias("method"), F.lit(0.5).alias("confidence"))
    return S._augment(found, hits, 5).select("query_id", "rank", "uri", "method")


@query(f"""WITH h AS (SELECT DISTINCT query_id, doc_id FROM ({_SNIP.format(q=_Q)})),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM h)
SELECT query_id, string_agg(concat('[', title, ']', chr(10), substr(content, 1, 1200)), chr(10) || chr(10) ORDER BY rank) AS prompt FROM r JOIN {_DOC_SQL} USING (doc_id) WHERE rank <= 5 GROUP BY query_id""")
def rag_prompt(spark, sf_dir):
    ix = search_index(spark, sf_dir)
    return S.prompt(S.search(asked(spark), ix, "keyword").where("method = 'keyword'"), ix.docs)


@query()
def batch_search(spark, sf_dir):
    q = asked_of_benchmark(spark, sf_dir).where("query_id < 10").withColumn("priority", F.col("query_id") % 3)
    return S.batch(q, search_index(spark, sf_dir), "keyword")


@query(f"""WITH r AS ({_bm25_sql('text', _Q, 10)}), j AS (SELECT query_id, rank, coalesce(quality = 1, false) AS relevant FROM r LEFT JOIN labels USING (doc_id)),
n AS (SELECT count(*) FILTER (quality = 1) AS n FROM labels),
p AS (SELECT query_id, min(rank) FILTER (relevant) AS first, count(*) FILTER (relevant AND rank <= 5) AS found FROM j GROUP BY query_id)
SELECT 'keyword' AS mode, count(*) AS queries, count(*) AS answered, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 4) AS hit_rate, round(avg(CAST(found AS DOUBLE) / least(n, 5)), 4) AS recall_at_5, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr FROM p, n""")
def eval_recall(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    ranked = _ranked(index.bm25_top(table(spark, sf_dir, "documents"), asked(spark), "doc_id", "text", 10))
    judged = ranked.join(labels, "doc_id", "left").crossJoin(labels.agg(F.count_if("good").alias("n_relevant")))
    return learner.evaluation(judged.select(F.lit("keyword").alias("mode"), "query_id", "rank", F.coalesce("good", F.lit(False)).alias("relevant"), "n_relevant"))


@query()
def rag_retrieval(spark, sf_dir):
    return S.retrieve(asked(spark), search_index(spark, sf_dir))


@query(f"SELECT uri, seq, title FROM (VALUES ('local://src1/doc1'), ('local://none/1')) AS k(uri) LEFT JOIN {_DOC_SQL} USING (uri) UNION ALL (SELECT uri, seq, title FROM {_DOC_SQL} WHERE doc_id % 100 = 3)")
def point_lookup(spark, sf_dir):
    docs = searchable(spark, sf_dir)
    keys = spark.createDataFrame([("local://src1/doc1",), ("local://none/1",)], "uri string").unionByName(docs.where("doc_id % 100 = 3").select("uri"))
    return S.lookup(docs.select("uri", "seq", "title"), keys)


@query()
def image_embedding(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", V.image_vector(F.col("html").cast("binary")).alias("v"))
    return pages.select("page_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("v")), 6).alias("norm"))
