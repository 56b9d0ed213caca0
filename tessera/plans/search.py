"""Search over a batch of queries: keyword, semantic, hybrid and multimodal, as one plan for all queries.

Documents are indexed once (built(), append()): postings of tokens by bucket, the tokens of names, what matching of names reads,
statistics and vectors lie in tables. A batch of queries then reads, of the postings, the buckets of its tokens; documents that may
hold a query as a substring come from the vocabulary (whose tokens meet the batch's words in one pass of an automaton) and the
postings, so no query is compared with every document. Scores are worked out for these candidates alone, once for all parts.

Candidates of every way to answer are made for all queries at once; a query takes those of its best way (its smallest tier).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions import vectors as V
from ..operators import index, knn, rank
from .stored import folder, held, settled, spread

MODES = ("keyword", "semantic", "hybrid", "multimodal")
#: What a document looks like to search; see operators.rank.
COLUMNS = ("seq", "store", "uri", "title", "content", "headings", "aliases", "tags", "links", "path", "parent", "context")
#: Postings lie in so many folders, by the token's hash.
BUCKETS = 32


@dataclass
class Corpus:
    """Documents, chunks of them (same columns, their own seq) and vectors (seq, embedding and, so that it need not be looked up, store) of either."""

    docs: DataFrame
    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    #: Made by the first search.
    index: Index | None = None

    @property
    def all(self) -> DataFrame:
        return self.docs if self.chunks is None else self.docs.unionByName(self.chunks)

    def embedded(self, dimensions: int = V.DIMENSIONS, characters: int = 2000) -> Corpus:
        """With vectors by feature hashing of each document and chunk, of whose text the first `characters` are read."""
        text = spread(self.all.select("seq", "store", F.substring(F.concat_ws("\n", "title", "content"), 1, characters).alias("t")))
        return Corpus(self.docs, self.chunks, V.hashed(text, "seq", "t", dimensions, "store"))


@dataclass
class Index:
    """Tables of a corpus ready for search, in one folder.

    docs: COLUMNS, is_doc (false for chunks), cluster, low (content in lower case) and what rank.prepared() adds
    postings: bucket, token, seq, tf, length; vocabulary: token, bucket; names: token, seq (documents only)
    stats: n documents and chunks, words in all; vectors: seq, store, embedding
    """

    path: str
    docs: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    names: DataFrame
    stats: DataFrame
    vectors: DataFrame | None
    #: Restricts searches to a store.
    store: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def of_store(self, store: str) -> Index:
        """The same index for the documents of one store: these alone are ranked, vectors before the nearest are chosen."""
        keys = self.docs.where(F.col("store") == store).select("seq")
        kept = {name: getattr(self, name).join(keys, "seq", "left_semi") for name in ("postings", "names")}
        stats = kept["postings"].select("seq", "length").distinct()
        stats = self.docs.where(F.col("store") == store).select("seq").join(stats, "seq", "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
        vectors = None if self.vectors is None else self.vectors.where(F.col("store") == store)
        return replace(self, docs=self.docs.where(F.col("store") == store), stats=stats, vectors=vectors, store=store, **kept)


_TABLES = ("docs", "postings", "vocabulary", "names", "stats", "vectors")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _write(corpus: Corpus, path: str, mode: str) -> None:
    spark = corpus.docs.sparkSession
    marked = corpus.docs.select(*COLUMNS, F.lit(True).alias("is_doc"))
    if corpus.chunks is not None:
        marked = marked.unionByName(corpus.chunks.select(*COLUMNS, F.lit(False).alias("is_doc")))
    ready = rank.prepared(_with_cluster(spread(marked))).withColumn("low", F.lower(T.text("content")))
    ready = ready.withColumn("_t", T.terms("title")).withColumn("_h", T.terms(F.array_join("headings", " ")))
    ready.write.mode(mode).parquet(f"{path}/docs")
    docs = spark.read.schema(ready.schema).parquet(f"{path}/docs") if mode != "append" else ready
    postings = index.postings(indexed(docs), "seq", "indexed").select(_bucket(), "token", F.col("key").alias("seq"), F.col("tf").cast("int").alias("tf"), "length")
    # A bucket of common tokens is cut into parts of the usual size.
    postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    places = F.array_distinct(F.concat(F.flatten(F.transform("_names", lambda x: x["t"])), T.tokens("_name"), T.tokens("_head"), "_t", "_h", T.tokens(T.folder_text(T.text("path")))))
    docs.where("is_doc").select(F.explode(places).alias("token"), "seq").write.mode(mode).parquet(f"{path}/names")
    fresh = postings if mode == "append" else spark.read.parquet(f"{path}/postings")
    stats = docs.agg(F.count("*").alias("n")).crossJoin(fresh.agg(F.coalesce(F.sum(F.col("tf").cast("long")), F.lit(0)).alias("words")))
    stats.write.mode(mode).parquet(f"{path}/stats")
    fresh.select("token", F.col("bucket").cast("int").alias("bucket")).distinct().write.mode(mode).parquet(f"{path}/vocabulary")
    if corpus.vectors is not None:
        placed = corpus.vectors if "store" in corpus.vectors.columns else corpus.vectors.join(docs.select("seq", "store"), "seq")
        placed.select("seq", "store", "embedding").write.mode(mode).parquet(f"{path}/vectors")


def built(corpus: Corpus, path: str | None = None) -> Index:
    """The index of a corpus, written to path (in the shared folder, for the time of the session, where there is none)."""
    spark = corpus.docs.sparkSession
    path = path or folder(spark, "index")
    _write(corpus, path, "overwrite")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """An index that built() wrote."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/vectors")
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    stats = table("stats").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    return Index(path, table("docs"), table("postings"), table("vocabulary").distinct(), table("names"), stats, table("vectors") if there else None)


def append(ix: Index, more: Corpus) -> Index:
    """The index with further documents, chunks and vectors, whose seq no earlier one has: only these are read and written."""
    _write(more, ix.path, "append")
    return opened(ix.spark, ix.path)


def _index(corpus: Corpus | Index) -> Index:
    if isinstance(corpus, Index):
        return corpus
    corpus.index = corpus.index or built(corpus)
    return corpus.index


def _with_cluster(df: DataFrame) -> DataFrame:
    return df.withColumn("cluster", T.cluster_key(F.col("parent"), F.col("path"), F.col("uri")))


def _adjusted(hits: DataFrame, docs: DataFrame, queries: DataFrame, boost: float, penalty: float) -> DataFrame:
    """Hits (query_id, seq, score, rank) with the score moved by title, folder and origin of the document, at most two of a cluster."""
    joined = _with_cluster(hits.join(docs, "seq").join(queries, "query_id"))
    q, c = F.col("query"), F.col
    moved = c("score") + boost * rank.lexical_boost(q, c("title"), c("headings"), c("tags"), c("links")) + rank.folder_prior(q, c("path")) - penalty * rank.external_penalty(q, c("title"), c("path"))
    order = [F.round("adjusted", 9).desc(), F.col("rank")]
    kept = rank.cap_clusters(joined.withColumn("adjusted", moved), ["query_id"], "cluster", order)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return kept.select("query_id", "seq", "uri", "cluster", F.col("adjusted").alias("score"), place.alias("rank"))


def indexed(docs: DataFrame) -> DataFrame:
    c = F.col
    return docs.withColumn("indexed", T.fielded(c("title"), c("headings"), c("aliases"), c("tags"), c("links"), c("content")))


def keyword_hits(queries: DataFrame, ix: Index, pool: int) -> DataFrame:
    """query_id, seq, score, rank by BM25: of the postings, those of the queries' tokens."""
    wanted = index.query_tokens(queries)
    tokens = wanted.select("token", _bucket()).distinct()
    tf = ix.postings.join(tokens, ["bucket", "token"])
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "token").join(wanted, "token").crossJoin(ix.stats)
    return index.top(index.scored(weighted, F.col("words") / F.col("n"), "seq"), pool, ["query_id"], F.round("score", 9).desc(), F.col("seq"))


def keyword_ranking(queries: DataFrame, corpus: Corpus | Index, pool: int) -> DataFrame:
    ix = _index(corpus)
    return _adjusted(keyword_hits(queries, ix, pool), ix.docs, queries, 1.0, 1.0)


def vector_ranking(queries: DataFrame, embedded: DataFrame, ix: Index, k: int = 5) -> DataFrame:
    """embedded: query_id, embedding."""
    hits = knn.knn(ix.vectors.withColumnRenamed("seq", "key"), embedded, k).withColumnRenamed("key", "seq")
    return _adjusted(hits, ix.docs, queries, 0.06, 0.25)


def fuse(semantic: DataFrame, keyword: DataFrame, limit: int) -> DataFrame:
    """query_id, seq, uri, cluster, rank, rrf and confidence of the best fused hits."""
    lists = semantic.withColumn("list", F.lit(0)).unionByName(keyword.withColumn("list", F.lit(1)))
    known = lists.groupBy("seq").agg(F.first("uri").alias("uri"), F.first("cluster").alias("cluster"))
    fused = rank.reciprocal_rank_fusion(lists.withColumnRenamed("seq", "id"))
    order = [F.round("rrf", 12).desc(), F.col("first")]
    best = index.top(fused, limit, ["query_id"], *order).withColumnRenamed("id", "seq").join(known, "seq")
    best = rank.cap_clusters(best, ["query_id"], "cluster", [F.col("rank")])
    sides = lists.select("query_id", "list", T.canonical_uri(F.col("uri")).alias("u")).distinct().groupBy("query_id", "u").agg(F.collect_set("list").alias("in"))
    overlap = sides.groupBy("query_id").agg(F.count_if(F.size("in") == 2).alias("shared"), F.count_if(F.array_contains("in", 0)).alias("l"), F.count_if(F.array_contains("in", 1)).alias("r"))
    strength = fused.groupBy("query_id").agg(rank.fused_strength(F.max("rrf")).alias("raw"))
    sure = strength.join(overlap, "query_id").select("query_id", rank.confidence(F.col("raw"), F.col("shared"), F.col("l"), F.col("r")).alias("confidence"))
    return best.join(sure, "query_id").select("query_id", "seq", "uri", "cluster", "rank", "rrf", "confidence")


def pairs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Every query with every document, both prepared; one side is a batch of queries, which travels to the documents."""
    return rank.prepared(_with_cluster(docs)).crossJoin(rank.prepared_queries(queries))


def _asking(ids: DataFrame, column: str, patterns: dict[str, list], kind) -> DataFrame:
    """query_id with the other columns of ids for each query that has a pattern (word: its queries) which the column holds as a substring."""
    others = [c for c in ids.columns if c != column]
    held = ids.sparkSession.sparkContext.broadcast(patterns)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, queries in held.value.items():
            automaton.add_word(word, queries)
        automaton.make_automaton()
        known: dict[str, list] = {}
        for batch in batches:
            at, who = [], []
            for i, token in enumerate(batch.column(column).to_pylist()):
                hits = known.get(token)
                if hits is None:
                    hits = known[token] = sorted({q for _, queries in automaton.iter(token) for q in queries}) if held.value else []
                at += [i] * len(hits)
                who += hits
            yield pa.RecordBatch.from_arrays([pa.array(who, arrow), *(batch.column(c).take(pa.array(at, pa.int64())) for c in others)], names=["query_id", *others])

    schema = ", ".join([f"query_id {kind.simpleString()}", *(f"{c} {ids.schema[c].dataType.simpleString()}" for c in others)])
    return ids.mapInArrow(run, schema)


def _read(queries: DataFrame) -> list:
    """The batch with what matching needs of it: _q, _words, low (trimmed, in lower case) and its words of over three letters."""
    ready = rank.prepared_queries(queries.select("query_id", "query")).withColumn("low", T.lower_trim("query"))
    return ready.withColumn("long", F.filter(F.split("low", r"\s+"), lambda w: F.length(w) > 3)).collect()


def _longest(text: str) -> str:
    """The longest run of token characters: a text that holds `text` has a token that holds this."""
    return max(re.findall(T.TOKEN, text), key=len, default="")


def _patterns(pairs: Iterator[tuple]) -> dict[str, list]:
    out: dict[str, list] = {}
    for query_id, word in pairs:
        if word and query_id not in out.setdefault(word, []):
            out[word].append(query_id)
    return out


def _holding(ix: Index, patterns: dict[str, list], kind) -> DataFrame:
    """query_id, seq of documents and chunks with a token that holds a pattern of the query as a substring."""
    tokens = _asking(ix.vocabulary.select("token", "bucket", F.col("token").alias("word")), "word", patterns, kind)
    return ix.postings.join(tokens, ["bucket", "token"]).select("query_id", "seq").distinct()


def matches(queries: DataFrame, ix: Index, rows: list | None = None) -> DataFrame:
    """query_id, seq, uri, cluster, file, score, arb, place of the documents whose names, headings, folder or beginning match a query.

    file: rank.exact_file_score; score and arb: rank.title_score and what settles between equals; place: file, prefix run and folder.
    Written out: several parts of a search use it.
    """
    rows = _read(queries) if rows is None else rows
    kind = queries.schema["query_id"].dataType
    named = _asking(ix.names.select("token", "seq"), "token", _patterns((r.query_id, w) for r in rows for w in r._words), kind)
    begun = _holding(ix, _patterns((r.query_id, max(r._words, key=len)) for r in rows if r._words and len(r._q) >= 4), kind)
    pairs = named.unionByName(begun).distinct().join(ix.docs.where("is_doc").drop("content", "low", "context"), "seq").join(rank.prepared_queries(queries.select("query_id", "query")), "query_id")
    pairs = pairs.withColumn("file", rank.exact_file_score()).withColumn("score", rank.title_score())
    run = F.greatest(T.prefix_run_of(F.col("_t"), F.col("_words")), T.prefix_run_of(F.col("_h"), F.col("_words")))
    pairs = pairs.withColumn("place", F.round(F.col("file") + run + rank.folder_prior(F.col("query"), F.col("path")), 9)).where("place > 0 OR score > 0")
    return settled(pairs.withColumn("arb", rank.arbitration(F.col("score"))).select("query_id", "seq", "uri", "cluster", "file", "score", "arb", "place"), "matches")


def _filed(ranked: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """ranked with its exact file match, file."""
    read = docs.select("seq", "_name", "_head", "_body")
    scored = ranked.join(read, "seq").join(rank.prepared_queries(queries), "query_id").withColumn("file", rank.exact_file_score())
    return scored.select(*ranked.columns, "file")


def post_filter(ranked: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Only the clusters of the best exact file match, where there is a good one. docs: prepared."""
    return rank.exact_file_filter(_filed(ranked, docs, queries), "query_id", "file", "cluster").drop("file")


def snippets(queries: DataFrame, corpus: Corpus | Index, rows: list | None = None) -> DataFrame:
    """query_id, seq, uri, cluster, snippet of every document (chunks do not count) that has one."""
    ix = _index(corpus)
    rows = _read(queries) if rows is None else rows
    kind = queries.schema["query_id"].dataType
    wanted = [(r.query_id, w) for r in rows for w in ([r.low] if r.low else []) + r.long]
    found = _holding(ix, _patterns((q, _longest(w)) for q, w in wanted), kind)
    odd = {q for q, w in wanted if not _longest(w)}
    docs = ix.docs.where("is_doc").select("seq", "uri", "cluster", "content", "low")
    if odd:  # words without any token character are in no vocabulary: their queries read the documents
        scanned = docs.select("seq").crossJoin(queries.where(F.col("query_id").isin(list(odd))).select("query_id"))
        found = found.unionByName(scanned).distinct()
    asked = queries.select("query_id", "query", T.lower_trim("query").alias("_low"))
    near = found.join(docs, "seq").join(asked, "query_id")
    long = F.filter(F.split("_low", r"\s+"), lambda w: (F.length(w) > 3) & F.contains("low", w))
    holds = ((F.length("_low") > 0) & F.contains("low", F.col("_low"))) | (F.size(long) > 0)
    return near.where(holds).select("query_id", "seq", "uri", "cluster", T.snippet(F.col("content"), F.col("query")).alias("snippet"))


def backstop(queries: DataFrame, corpus: Corpus | Index, limit: int, matched: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """query_id, seq, uri, cluster, rank: keyword ranking, then documents whose name, headings or folder match, one of each cluster."""
    ix = _index(corpus)
    pool = max(2 * limit, 5)
    hits = keyword_hits(queries, ix, pool) if hits is None else hits.where(F.col("rank") <= pool)
    ranked = _adjusted(hits, ix.docs, queries, 1.0, 1.0).withColumn("part", F.lit(0)).withColumn("place", -F.col("rank").cast("double"))
    direct = (matches(queries, ix) if matched is None else matched).where("place > 0").withColumn("part", F.lit(1))
    columns = ("query_id", "seq", "uri", "cluster", "part", "place")
    both = _filed(ranked.select(*columns), ix.docs, queries).unionByName(direct.select(*columns, "file"))
    kept = rank.exact_file_filter(settled(both, "backstop"), "query_id", "file", "cluster")
    order = [F.col("part"), F.col("place").desc(), F.col("seq")]
    one = rank.cap_clusters(kept, ["query_id"], "cluster", order, 1)
    return index.top(one, limit, ["query_id"], *order).select("query_id", "seq", "uri", "cluster", "rank")


def exact(queries: DataFrame, corpus: Corpus | Index, limit: int, matched: DataFrame | None = None) -> DataFrame:
    found = rank.resolved((matches(queries, _index(corpus)) if matched is None else matched).where("score > 0"), limit)
    return found.select("query_id", "seq", "uri", "cluster", F.col("n").alias("rank"), "confidence")


def _tier(df: DataFrame, tier: int, method: str, confidence=None) -> DataFrame:
    value = F.col("confidence") if confidence is None else F.lit(confidence)
    return df.select("query_id", "seq", "uri", "rank", F.lit(tier).alias("tier"), F.lit(method).alias("method"), value.alias("confidence"))


def _best(tiers: list[DataFrame], limit: int) -> DataFrame:
    all_ = tiers[0]
    for t in tiers[1:]:
        all_ = all_.unionByName(t)
    first = all_.withColumn("_first", F.min("tier").over(Window.partitionBy("query_id"))).where("tier = _first")
    return first.where(F.col("rank") <= limit).drop("_first")


def _fallback(queries: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    first = docs.select("seq", "uri").orderBy("seq").limit(limit).select("seq", "uri", F.row_number().over(Window.orderBy("seq")).alias("rank"))
    return queries.select("query_id").crossJoin(first)


def embed_queries(queries: DataFrame, dimensions: int = V.DIMENSIONS) -> DataFrame:
    return V.hashed(queries, "query_id", "query", dimensions)


def embed_with_pictures(queries: DataFrame, text_weight: float = 0.7, picture_weight: float = 0.3) -> DataFrame:
    """query_id, embedding of queries (query_id, query, picture: bytes): both vectors blended; the text's alone where there is no picture."""
    words = embed_queries(queries)
    seen = queries.select("query_id", F.when(F.length("picture") > 0, V.image_vector("picture")).alias("seen"))
    mixed = V.blend(F.col("embedding"), F.col("seen"), text_weight, picture_weight)
    return words.join(seen, "query_id").select("query_id", F.when(F.col("seen").isNull(), F.col("embedding")).otherwise(mixed).alias("embedding"))


def _width(ix: Index) -> int:
    return ix.vectors.select(F.size("embedding")).first()[0]


def search(queries: DataFrame, corpus: Corpus | Index, mode: str = "hybrid", max_sources: int = 5, alpha: float = 0.5, embedded: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """query_id, rank, uri, title, method, confidence, verdict, snippet of the sources of each query (query_id, query).

    embedded: query_id, embedding; made by feature hashing where it is not given (a blend with picture vectors for multimodal search).
    store: only documents of this store are ranked.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    ix = _index(corpus)
    ix = ix.of_store(store) if store is not None else ix
    queries = held(queries.select("query_id", "query"))
    rows = _read(queries)
    matched = matches(queries, ix, rows)
    named = held(exact(queries, ix, max_sources, matched))
    # As many as a full list of sources can leave out.
    hits = held(index.top(snippets(queries, ix, rows).drop("snippet"), 2 * max_sources, ["query_id"], F.col("seq")))
    ranked = held(keyword_hits(queries, ix, max(rank.pool_size(max_sources, alpha), 2 * max_sources, 5)))
    net = held(backstop(queries, ix, max_sources, matched, ranked))
    last = held(_tier(_fallback(queries, ix.docs.where("is_doc"), max_sources), 9, "none", 0.3))
    if mode == "keyword":
        found = _best([_tier(hits, 1, "keyword", 0.7), _tier(named, 2, "exact"), _tier(net, 3, "backstop", 0.5), last], max_sources)
    else:
        embedded = embed_queries(queries, _width(ix)) if embedded is None else embedded
        near = held(vector_ranking(queries, embedded, ix))
        if mode == "hybrid":
            keyword = _adjusted(ranked.where(F.col("rank") <= rank.pool_size(max_sources, alpha)), ix.docs, queries, 1.0, 1.0)
            fused = held(fuse(near, keyword, max_sources))
            level = fused.groupBy("query_id").agg(F.max("confidence").alias("level"))
            # The named file wins where it is surer than the fusion; a poor result gives way to the backstop.
            sure = named.join(level, "query_id", "left").where("level IS NULL OR confidence > level").drop("level")
            kept = post_filter(fused, ix.docs, queries)
            poor = net.join(level.where(rank.verdict(F.col("level")) == "INHIBIT"), "query_id").withColumnRenamed("level", "confidence")
            found = _best([_tier(sure, 1, "exact"), _tier(poor, 2, "backstop"), _tier(kept, 3, "fused"), _tier(hits, 4, "keyword", 0.7), last], max_sources)
            found = _augment(held(found), hits, max_sources)
        else:
            vector = _tier(post_filter(near, ix.docs, queries).drop("score"), 5, "vector", 0.3)
            first = [_tier(named, 1 if mode == "semantic" else 3, "exact"), _tier(hits, 2, "keyword", 0.7)]
            found = _best([*first, _tier(net, 4, "backstop", 0.45), vector, last], max_sources)
    return _titled(held(found), ix, queries)


def _titled(found: DataFrame, ix: Index, queries: DataFrame) -> DataFrame:
    c = F.col
    titled = found.join(ix.docs.select("seq", "title", "headings", "context", "content"), "seq").join(queries.select("query_id", "query"), "query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "seq"))
    out = titled.select("query_id", place.alias("rank"), "uri", "title", "method", F.round("confidence", 4).alias("confidence"), rank.verdict(c("confidence")).alias("verdict"), T.excerpt(c("headings"), c("context"), c("content"), c("query")).alias("snippet"))
    return out


def answers(found: DataFrame) -> DataFrame:
    """query_id, answer, n_sources of the result of a search: the snippet of its best source."""
    return found.groupBy("query_id").agg(F.min_by("snippet", "rank").alias("answer"), F.count("*").alias("n_sources"))


def _augment(found: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Results between poor and good are filled up with documents that hold the query, in the order of the store."""
    middling = found.groupBy("query_id").agg(F.max("confidence").alias("confidence"), F.max("rank").alias("n")).where(rank.verdict(F.col("confidence")) == "FORGE")
    unseen = hits.select("query_id", "seq", "uri").join(found.select("query_id", "uri"), ["query_id", "uri"], "left_anti").join(middling, "query_id")
    first = index.top(unseen, limit, ["query_id"], F.col("seq"))  # no more are asked for, and so many a task send on
    more = first.withColumn("rank", F.col("n") + F.col("rank")).where(F.col("rank") <= limit)
    return found.unionByName(more.select("query_id", "seq", "uri", "rank", F.lit(8).alias("tier"), F.lit("augmented").alias("method"), "confidence"))


def retrieve(queries: DataFrame, corpus: Corpus | Index, max_sources: int = 5, embedded: DataFrame | None = None) -> DataFrame:
    """What a language model is given: the named file, else near vectors, else documents that hold the query, else the backstop; columns as of search."""
    ix = _index(corpus)
    rows = _read(queries)
    matched = matches(queries, ix, rows)
    embedded = embed_queries(queries, _width(ix)) if embedded is None else embedded
    near = post_filter(vector_ranking(queries, embedded, ix, max_sources), ix.docs, queries)
    body = F.lower(T.contextual(F.col("headings"), F.col("content"), F.col("context")))
    candidates = _holding(ix, _patterns((r.query_id, _longest(r.low)) for r in rows), queries.schema["query_id"].dataType)
    # The labels of parts, too, are text that a query can be found in.
    labelled = [r.query_id for r in rows if r.low and (not _longest(r.low) or any(_longest(r.low) in x for x in ("headings", "context", "passage")))]
    docs = ix.docs.where("is_doc")
    if labelled:
        candidates = candidates.unionByName(docs.select("seq").crossJoin(queries.where(F.col("query_id").isin(labelled)).select("query_id")).select("query_id", "seq")).distinct()
    holding = candidates.join(docs, "seq").join(queries, "query_id").where(F.contains(body, T.lower_trim("query"))).select("query_id", "seq", "uri")
    holding = index.top(holding, max_sources, ["query_id"], F.col("seq"))
    tiers = [_tier(exact(queries, ix, max_sources, matched), 1, "exact"), _tier(near.drop("score"), 2, "vector", 0.7), _tier(holding, 3, "substring", 0.55), _tier(backstop(queries, ix, max_sources, matched), 4, "backstop", 0.45)]
    found = settled(_best(tiers, max_sources), "found").join(ix.docs.select("seq", "title"), "seq")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "seq"))
    out = found.select("query_id", place.alias("rank"), "uri", "title", "method", F.round("confidence", 4).alias("confidence"))
    return out.withColumn("low_confidence", F.col("confidence") <= rank.LOW)


def lookup(df: DataFrame, keys: DataFrame, key: str = "uri") -> DataFrame:
    """Rows of the asked keys; keys that are not there give a row of nulls."""
    return keys.select(key).distinct().join(df, key, "left")


def exported(chunks: DataFrame) -> DataFrame:
    """text and metadata of chunks, the shape that loaders of other frameworks take."""
    return chunks.select("text", F.struct("headings", F.col("idx").alias("chunk_index")).alias("metadata"))


def prompt(sources: DataFrame, docs: DataFrame, each: int = 1200) -> DataFrame:
    """query_id, prompt: what a language model would be given, the best documents cut to `each` characters."""
    body = sources.join(docs.select("uri", "content"), "uri").select("query_id", "rank", F.concat(F.lit("["), "title", F.lit("]\n"), F.substring("content", 1, each)).alias("t"))
    return body.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n\n").alias("prompt"))


def batch(requests: DataFrame, corpus: Corpus | Index, mode: str = "hybrid", max_sources: int = 5) -> DataFrame:
    """Requests (query_id, query, priority and, where it is there, max_results) in order of priority with the number of their sources, at most
    max_results, and a status; invalid queries are errors."""
    from ..operators.ingest import query_problem

    checked = requests.withColumn("problem", query_problem(F.col("query")))
    if "max_results" not in requests.columns:
        checked = checked.withColumn("max_results", F.lit(max_sources))
    checked = checked.withColumn("max_results", F.greatest(F.lit(1), F.coalesce("max_results", F.lit(max_sources))))
    found = search(checked.where("problem IS NULL").select("query_id", "query"), corpus, mode, max_sources)
    found = found.join(checked.select("query_id", "max_results"), "query_id").where(F.col("rank") <= F.col("max_results"))
    counted = found.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.max("confidence").alias("confidence"))
    status = F.when(F.col("problem").isNotNull(), "error").otherwise("success")
    return checked.join(counted, "query_id", "left").select("query_id", "priority", status.alias("status"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "confidence").orderBy(F.col("priority").desc(), "query_id")
