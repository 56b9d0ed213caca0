"""Scores, fusion and filters over pairs of query and document.

Documents have: seq (order of arrival), store, uri, title, content, headings, aliases, tags, links (arrays), path and parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RRF_K = 60
#: Parts of paths that mark what a store holds of others; external_penalty() takes other marks.
EXTERNAL = ("external",)
LOW, HIGH, FLOOR = 0.45, 0.75, 0.25


def lexical_boost(query: Column, title: Column, headings: Column, tags: Column, links: Column) -> Column:
    q, words = T.lower_trim(query), T.terms(query)
    head = F.array_join(headings, " | ")
    found = (
        F.when(F.contains(F.lower(T.text(title)), q), 4.0).otherwise(0.0)
        + F.when(F.contains(F.lower(head), q), 2.5).otherwise(0.0)
        + 0.75 * T.term_hits(title, words)
        + 0.35 * T.term_hits(head, words)
        + 0.2 * T.term_hits(F.array_join(tags, " "), words)
        + 0.15 * T.term_hits(F.array_join(links, " "), words)
    )
    return F.when((F.length(q) > 0) & (F.size(words) > 0), found).otherwise(0.0)


def folder_prior(query: Column, path: Column) -> Column:
    folder, words = T.folder_text(T.text(path)), T.terms(query)
    whole = F.when(F.contains(T.lookup_text(folder), T.lookup_text(query)), 0.35).otherwise(0.0)
    return F.when((F.length(T.text(path)) > 0) & (F.size(words) > 0), 0.12 * T.term_hits(folder, words) + whole).otherwise(0.0)


def external_penalty(query: Column, title: Column, path: Column, marks: tuple[str, ...] = EXTERNAL) -> Column:
    low = F.lower(T.text(path))
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains(low, F.lit(m))
    q = T.lower_trim(query)
    named = (F.length(q) > 0) & F.contains(F.lower(T.text(title)), q)
    return F.when(marked & ~named, 0.6).otherwise(0.0)


def _names(title: Column, path: Column, aliases: Column) -> Column:
    return F.concat(F.array(T.text(title), T.stem(T.text(path))), F.coalesce(aliases, F.array().cast("array<string>")))


def prepared(docs: DataFrame) -> DataFrame:
    """Adds what matching of names reads of a document, so it is worked out once for each document and not for each query: _names (normalised
    names with their terms), _name (all of them), _head, _body, _titled (terms of a title that is a file name, else null)."""
    c = F.col
    names = _names(c("title"), c("path"), c("aliases"))
    title = F.lower(T.text(c("title")))
    known = F.filter(F.transform(names, lambda n: F.struct(T.lookup_text(n).alias("n"), T.terms(n).alias("t"))), lambda x: F.length(x["n"]) > 0)
    return docs.select(
        "*",
        known.alias("_names"),
        T.lookup_text(F.array_join(names, " ")).alias("_name"),
        T.lookup_text(F.array_join("headings", " ")).alias("_head"),
        # let() also keeps Spark from putting this into the loop of a join with queries, where it would be worked out for each of them.
        T.let(F.substring(T.strip(T.text(c("content"))), 1, 2000), T.lookup_text).alias("_body"),
        F.when(title.rlike(r"\.(md|txt)$"), F.size(T.terms(T.stem(title)))).alias("_titled"),
    )


def prepared_queries(queries: DataFrame) -> DataFrame:
    """Adds _q, the normalised query, and _words, its terms."""
    return queries.select("*", T.lookup_text("query").alias("_q"), T.terms("query").alias("_words"))


def exact_file_score() -> Column:
    """How well a query names a file, over prepared documents and queries."""
    q, words = F.col("_q"), F.col("_words")
    best = F.greatest(
        F.when(F.contains("_name", q), 5.0).otherwise(0.0),
        F.when(T.contains_all(F.col("_name"), words), 4.5).otherwise(0.0),
        F.when(F.contains("_head", q), 4.0).otherwise(0.0),
        F.when(T.contains_all(F.col("_head"), words), 3.5).otherwise(0.0),
        F.when(F.contains("_body", q), 3.0).otherwise(0.0),
    )
    return F.when(F.length(q) >= 4, best).otherwise(0.0)


def title_score() -> Column:
    """How well a query matches one of a document's names, over prepared documents and queries."""
    q, words = F.col("_q"), F.col("_words")

    def one(x: Column) -> Column:
        kind = F.when(x["n"] == q, 7.0).when(F.contains(x["n"], q), 6.0).when(T.contains_all(x["n"], words), 5.2).otherwise(0.0)
        return kind + 1.2 * T.prefix_run_of(x["t"], words)

    return F.when(F.length(q) >= 4, F.coalesce(F.array_max(F.transform("_names", one)), F.lit(0.0))).otherwise(0.0)


def arbitration(score: Column) -> Column:
    """What settles between files whose titles match alike, as a struct that compares field by field; over prepared documents and queries."""
    q, words, head = F.col("_q"), F.col("_words"), F.col("_head")
    shortest = F.array_min(F.transform("_names", lambda x, i: F.struct(F.length(x["n"]).alias("l"), i.alias("i"), x["n"].alias("n"), x["t"].alias("t"))))
    name, own = F.coalesce(shortest["n"], F.lit("")), F.coalesce(shortest["t"], F.array().cast("array<string>"))
    known = (F.length(name) > 0) & (F.length(q) > 0)
    extra = F.size(F.array_except(own, words)) + F.when(F.size(F.array_except(words, own)) > 0, 10).otherwise(0)
    gap = F.greatest(F.lit(0), F.length(name) - F.length(q))
    noise = F.coalesce(F.greatest(F.lit(0), F.col("_titled") - F.size(words)), F.lit(0))
    noise = F.when(F.col("_titled").isNull(), 0).otherwise(noise)
    return F.struct(
        F.round(score, 4).alias("score"),
        (known & (name == q)).cast("int").alias("exact"),
        (known & F.startswith(name, q)).cast("int").alias("prefix"),
        ((F.length(head) > 0) & (F.length(q) > 0) & F.startswith(head, q)).cast("int").alias("heading"),
        (-F.when(known, extra).otherwise(999)).alias("extra"),
        (-(F.when(known, gap).otherwise(999) + noise)).alias("gap"),
    )


def exact_notes(pairs: DataFrame, per_cluster: int = 2) -> DataFrame:
    """query_id, seq, uri, cluster, n, confidence: for each query the documents of the one cluster whose title it names, where it is clear.

    pairs: prepared documents, each with its cluster, with prepared queries.
    """
    return resolved(pairs.withColumn("score", title_score()).where("score > 0").withColumn("arb", arbitration(F.col("score"))), per_cluster)


def resolved(scored: DataFrame, per_cluster: int = 2) -> DataFrame:
    """exact_notes() of pairs with their score (title_score, above 0) and arb (arbitration)."""
    scored = scored.select("query_id", "seq", "uri", "cluster", "score", "arb")
    best = scored.groupBy("query_id", "cluster").agg(F.max("score").alias("score"), F.max("arb").alias("arb"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("arb").desc(), F.col("cluster"))
    two = best.withColumn("n", F.row_number().over(order)).where("n <= 2")  # which limits each group before the shuffle
    ranked = two.select("*", F.lead("score").over(order).alias("score2"), F.lead("arb").over(order).alias("arb2")).where("n = 1 AND score >= 5.2")
    close = F.col("score2").isNotNull() & (F.col("score") < 6) & (F.col("score") - F.col("score2") < 0.55)

    def tail(name: str) -> Column:
        return F.struct(*(F.col(f"{name}.{f}").alias(f) for f in ("exact", "prefix", "heading", "extra", "gap")))

    ahead = (F.col("arb") > F.col("arb2")) & (tail("arb") > tail("arb2")) & ((F.col("arb.extra") - F.col("arb2.extra") >= 1) | (F.col("arb.gap") - F.col("arb2.gap") >= 8))
    clear = ranked.where(~close | ahead)
    confidence = F.when(F.col("best") >= 7, 0.92).when(F.col("best") >= 6, 0.88).otherwise(0.84)
    chosen = scored.drop("score", "arb").join(clear.select("query_id", "cluster", F.col("score").alias("best")), ["query_id", "cluster"])
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))
    return chosen.withColumn("n", n).where(F.col("n") <= per_cluster).withColumn("confidence", confidence)


def cap_clusters(ranked: DataFrame, by: list[str], cluster: str, order: list[Column], limit: int = 2) -> DataFrame:
    """At most `limit` rows of each cluster, the first in order."""
    n = F.row_number().over(Window.partitionBy(*by, cluster).orderBy(*order))
    return ranked.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def exact_file_filter(pairs: DataFrame, by: str, score: str, cluster: str) -> DataFrame:
    """Where a document's file match reaches 3, only documents of the clusters that hold the best match stay.

    The best is found by partial maxima, so no task reads all of a query's pairs; pairs are read twice.
    """
    clusters = pairs.groupBy(by, cluster).agg(F.max(score).alias("_most"))
    wins = clusters.join(clusters.groupBy(by).agg(F.max("_most").alias("_best")), by).where("_best < 3 OR _most >= _best")
    wins = wins.select(F.col(by).alias("_by"), F.col(cluster).alias("_cluster"))
    return pairs.join(wins, (F.col(by) == F.col("_by")) & F.col(cluster).eqNullSafe(F.col("_cluster")), "left_semi")


def reciprocal_rank_fusion(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, id, rrf, score from query_id, list (0 first), id, rank: sums of 1 / (k + rank)."""
    fused = lists.groupBy("query_id", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"))
    return fused.withColumn("score", F.least(F.lit(1.0), F.col("rrf") / 2))


def fused_strength(top_rrf: Column, lists: int = 2, k: int = RRF_K) -> Column:
    """The best fused score as a share of what a document at the head of every list has."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(top_rrf, F.lit(0.0)) / (lists / (k + 1))))


def confidence(raw: Column, shared: Column, left: Column, right: Column, floor: float = FLOOR) -> Column:
    """Fusion strength, lowered by how far two lists of sizes left and right disagree."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    agreement = (shared / F.least(left, right) + shared / F.greatest(left, right)) / 2
    factor = F.when((left == 0) | (right == 0), F.lit(floor)).otherwise(F.greatest(F.lit(floor), agreement))
    return F.when((left == 0) & (right == 0), r).otherwise(F.round(r * factor, 4))


def verdict(c: Column) -> Column:
    return F.when(c > HIGH, "PASS").when(c > LOW, "FORGE").otherwise("INHIBIT")


def pool_size(sources: int, alpha: float) -> int:
    """Documents that the keyword side brings in; more, the more it is trusted."""
    return max(1, int(sources * 2 * max(0.5, 1.5 - alpha)))
