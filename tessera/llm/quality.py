"""Quality by hierarchical empirical Bayes: a document classifier's evidence together with its host's and path's posteriors.

1. A logistic regression on ten measures of a text (words, distinct words, shares of symbols, capitals, digits ...), fitted to a
   bounded sample of SAMPLE labelled documents of each class, gives every document a probability p.
2. Hosts: with n documents and the sum s of their p, a host's posterior is (s + k m) / (n + k) around the global mean m; paths
   shrink in the same way toward their host's posterior. The strengths k come from the data by the method of moments: the less
   sites differ beyond what chance explains, the harder they are pulled to the prior, and sparse sites most of all.
3. A document's own p is left out of its site's sums, so no evidence counts twice. Evidence adds up in log-odds:
   logit(final) = logit(p) + logit(path) - logit(m).

One pass scores the texts; what follows is grouped aggregation over numbers, with partial sums on the map side, so hot hosts are no
skew; sites meet their documents in a join of numbers.

Defined results: a null text counts as empty; null host and null path are sites of their own; repeated rows count each; a null
doc_id stays null; without labels of both classes p is 0.5 throughout; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, scan, stored

SAMPLE = 6000
FEATURES = ("log_words", "distinct", "word_length", "symbols", "capitals", "digits", "exclamations", "bars", "newlines", "stops")
THRESHOLD = 0.5
#: A probability is evidence of at most this many to one.
ODDS = 99.0
_CLASS = np.zeros(256, dtype=np.uint8)
for _n, _set in enumerate((b"#$%&*<>{}=~^\\@_", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|", b"\n", b".,;:"), 1):
    _CLASS[list(_set)] = _n


def measures(texts: pa.Array, words: Words) -> np.ndarray:
    """(texts, features) of texts, whose words are given."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    n = len(raw)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    share = np.bincount(row * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8) / np.maximum(size, 1)[:, None]
    count = np.diff(words.first)
    key = np.sort((np.repeat(np.arange(n, dtype=np.uint64), count) << np.uint64(40)) | (words.hash >> np.uint64(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=bool)
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    # Long texts repeat more words by nature: distinct words are held against what a text of this length has.
    expected = np.maximum(count, 1) ** 0.9
    return np.stack([np.log1p(count), distinct / expected, np.minimum(size / np.maximum(count, 1), 50), *(share[:, i] for i in range(1, 8))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the raw features and a constant, by Newton's method on standardised features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(0), "")
        for lo, hi, words in scan(texts):
            x = measures(texts.slice(lo, hi - lo), words)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights fitted to a bounded sample of labelled documents (smallest md5(doc_id) of each class); None without both classes."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("quality") > 0).cast("double").alias("_y")).distinct()
    chosen = [known.where(F.col("_y") == y).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample) for y in (0.0, 1.0)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("_id"))
    found = rows.select("text", "_y").mapInArrow(_features, "y double, x array<double>").toPandas()
    y, x = found["y"].to_numpy(dtype=np.float64), np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    if len(np.unique(y)) < 2:
        return None
    order = np.lexsort([*x.T, y])  # rows come in any order; sums must not depend on it
    return fit_logistic(x[order], y[order])


def classify(docs: DataFrame, weights: np.ndarray | None, host: str, path: str) -> DataFrame:
    """doc_id, host, path and p of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(3), "")
            for lo, hi, words in scan(texts):
                x = measures(texts.slice(lo, hi - lo), words)
                z = np.zeros(hi - lo) if weights is None else x @ weights[:-1] + weights[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(p)], names=["doc_id", "host", "path", "p"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    site = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (host, path)]
    return docs.select("doc_id", site[0].alias("host"), F.concat_ws("/", *site).alias("path"), "text").mapInArrow(run, f"doc_id {kind}, host string, path string, p double")


def _strength(sites: DataFrame, level: str) -> DataFrame:
    """One row: the strength k of the prior of sites (n, s, q: count, sum and sum of squares of p; prior: the mean they shrink to).

    Beyond the variance within sites, sites differ by v; a prior Beta(k m, k (1 - m)) has that variance at k = m (1 - m) / v - 1.
    """
    deviation = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("prior"), 2))
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    total, used, sites_n = F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count("*")
    noise = within / F.greatest(total - sites_n, F.lit(1))
    between = F.greatest((deviation - (sites_n - 1) * noise) / F.greatest(total - used / total, F.lit(1e-9)), F.lit(1e-6))
    mean = F.sum("s") / total
    return sites.agg(F.least(F.lit(1e6), F.greatest(F.lit(1.0), mean * (1 - mean) / between - 1)).alias(level))


def _logit(p: Column) -> Column:
    low = F.lit(1 / (1 + ODDS))
    q = F.least(F.greatest(p, low), 1 - low)
    return F.log(q / (1 - q))


def posteriors(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p, host_posterior, path_posterior, quality and keep from doc_id, host, path and p."""
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = scored.groupBy("host", "path").agg(*sums)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    every = hosts.agg(F.sum("n").alias("all_n"), (F.sum("s") / F.sum("n")).alias("m"))
    host_k = _strength(hosts.crossJoin(F.broadcast(every.select(F.col("m").alias("prior")))), "host_k")
    shrunk = hosts.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(host_k)).select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), "m", "host_k")
    prior = (F.col("host_s") + F.col("host_k") * F.col("m")) / (F.col("host_n") + F.col("host_k"))
    with_host = paths.join(shrunk, "host")
    path_k = _strength(with_host.withColumn("prior", prior), "path_k")
    sites = with_host.crossJoin(F.broadcast(path_k)).select("path", "n", "s", "host_n", "host_s", "host_k", "path_k", "m")
    joined = scored.select("doc_id", "path", "p").join(sites, "path")
    host = (F.col("host_s") - F.col("p") + F.col("host_k") * F.col("m")) / (F.col("host_n") - 1 + F.col("host_k"))
    path = (F.col("s") - F.col("p") + F.col("path_k") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("path_k"))
    out = joined.withColumn("host_posterior", host).withColumn("path_posterior", path)
    z = _logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(F.col("m"))
    out = out.withColumn("quality", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("p", "host_posterior", "path_posterior", "quality")), (F.col("quality") >= threshold).alias("keep"))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p, host_posterior, path_posterior, quality and keep for each document; see the module for edge cases."""
    return posteriors(stored(classify(docs, train(docs, labels), host, path), "scored"), threshold)
