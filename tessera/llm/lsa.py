"""Benchmark decontamination by latent semantic retrieval, longest common subsequence and answer words.

1. Every document is read as passages of HALF words. Words fall into BUCKETS by their hash; the number of passages that hold
   a bucket is counted over all documents and gives its idf.
2. Randomised SVD of the passages' TF-IDF matrix A: each task adds up its share of Y = A'(A G) for one fixed Gaussian G of
   RANK columns; the eigendecomposition of G'Y (RANK x RANK) turns Y into right singular vectors and values. One pass over
   the corpus; what moves is one BUCKETS x RANK matrix for each task.
3. Windows of two adjacent passages, and likewise of every benchmark item, are projected to whitened latent space; a window of a
   document and an item are a candidate pair where the cosine with some window of the item is COSINE or more.
4. Candidates are verified on the words themselves, in the region around the window that an item of that length can reach: the
   item's rarest words (its answer) must occur to ANSWER at least, and the longest common subsequence of item and region, by
   bit vectors of as many words as the item needs, must reach LCS of the item.

All three conditions must hold, so they are tried in the order of their cost: the answer words are looked up in an index of the
items first, the exact cosine of each pair left follows, then the sequence. What comes out is what comparing every window of every
document with every window of every item would give, but the work grows with the answer words that texts hold, not with the number of
items. Items travel to the tasks in slices of SLICE, one pass for each, so their number bounds no array.

Items of fewer than MIN_WORDS words have no passage to compare; they match where all their words stand in a row.

Defined results: null, empty and wordless texts match nothing, nor do null, empty and wordless items or those without item_id; of
equally rare words of an item those of the smallest hash are its answer; texts and items are taken whole, however long; rows that
agree in doc_id report once for each item, and so do items that agree in item_id; an empty benchmark or table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mix, scan, summed, tokenised, unblob, within

HALF = 16
BUCKETS = 1 << 15
RANK = 32
#: Paraphrases down to the LCS limit have this or more to 0.95 (README); the checks that follow remove the rest.
COSINE = 0.3
LCS, ANSWER, ANSWER_WORDS = 0.5, 0.6, 5
MIN_WORDS = 8
#: Items that one pass looks for.
SLICE = 100_000
_STEP, _BITS = 20_000, 64


class Blocks(NamedTuple):
    """Texts cut into rows of HALF words; `row` tells the text of each."""

    words: np.ndarray  # (n, HALF) uint32
    bucket: np.ndarray  # (n, HALF) uint16, BUCKETS where a text has ended
    row: np.ndarray


def blocks(ids: np.ndarray, first: np.ndarray) -> Blocks:
    lengths = np.diff(first)
    count = -(-lengths // HALF)
    start = np.cumsum(count) - count
    t = within(lengths)
    at = np.repeat(start * HALF, lengths) + t
    words = np.zeros(int(count.sum()) * HALF, dtype=np.uint32)
    bucket = np.full(len(words), BUCKETS, dtype=np.uint16)
    words[at] = ids
    bucket[at] = ids & np.uint32(BUCKETS - 1)
    return Blocks(words.reshape(-1, HALF), bucket.reshape(-1, HALF), np.repeat(np.arange(len(lengths)), count))


def passages_with(bucket: np.ndarray) -> np.ndarray:
    """Number of rows that hold each bucket."""
    s = np.sort(bucket, axis=1)
    new = np.ones(s.shape, dtype=bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    return np.bincount(s[new], minlength=BUCKETS + 1)[:BUCKETS]


def gaussian() -> np.ndarray:
    g = np.random.default_rng(20240229).standard_normal((BUCKETS + 1, RANK)).astype(np.float32)
    g[BUCKETS] = 0
    return g


def sketch(bucket: np.ndarray, idf: np.ndarray, weighted: np.ndarray, y: np.ndarray) -> None:
    """Adds A'(A G) of these rows, up to the final factor idf of each bucket, to y; weighted is idf * G, rows of A have norm 1."""
    square = idf * idf
    for lo in range(0, len(bucket), _STEP):
        b = bucket[lo : lo + _STEP]
        z = weighted[b[:, 0]].copy()
        for j in range(1, HALF):
            z += weighted[b[:, j]]
        z /= square[b].sum(axis=1, keepdims=True) + 1e-9
        flat = b.ravel()
        order = np.argsort(flat, kind="stable")
        there = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]]))
        y[there[starts]] += np.add.reduceat(z[order // HALF], starts, axis=0)


def factor(y: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values from y = A'A g."""
    core = g.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(1e-9, 1e-6 * values[-1])
    u, s, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u, s


class Items(NamedTuple):
    """Benchmark items of one length class, ready for search."""

    query: np.ndarray  # (q, rank) unit vectors
    query_first: np.ndarray  # item i has queries query_first[i]:query_first[i + 1]
    item: np.ndarray  # item_id of each
    words: np.ndarray  # (items, a multiple of 64) uint32
    length: np.ndarray
    answer: np.ndarray  # sorted (word << 32 | item)
    number: np.ndarray  # which of its item's answer words each is
    need: np.ndarray  # answer words that each item needs
    total: np.ndarray
    before: int  # half windows before and after a window's first that its region holds
    after: int


class Short(NamedTuple):
    """Items of one length under MIN_WORDS."""

    item: np.ndarray
    words: np.ndarray  # (items, length) uint32, sorted by key
    key: np.ndarray


class Space(NamedTuple):
    projection: np.ndarray  # (BUCKETS + 1, rank): idf times the whitened basis
    groups: list[Items]
    short: list[Short]


def windows(b: Blocks, projection: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the windows that begin with each row."""
    z = projection[b.bucket[:, 0]].copy()
    for j in range(1, HALF):
        z += projection[b.bucket[:, j]]
    out = z.copy()
    same = b.row[1:] == b.row[:-1]
    out[:-1][same] += z[1:][same]
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)


def _run_key(words: np.ndarray, n: int) -> np.ndarray:
    """A key of every n words in a row."""
    key = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for j in range(n):
        key = mix(key * np.uint64(31) + words[j : j + len(key)].astype(np.uint64) + np.uint64(j))
    return key


def prepare(ids: list, words: list[np.ndarray], idf: np.ndarray, projection: np.ndarray) -> tuple[list[Items], list[Short]]:
    """Items by class of length, and those of fewer than MIN_WORDS words."""
    by: dict[int, list[tuple]] = {}
    for item, w in zip(ids, words):
        if len(w):
            by.setdefault(-len(w) if len(w) < MIN_WORDS else -(-len(w) // _BITS), []).append((item, w))
    out, short = [], []
    for kind, some in sorted(by.items()):
        if kind < 0:
            table = np.stack([w for _, w in some])
            key = np.concatenate([_run_key(w, -kind) for _, w in some])
            order = np.argsort(key, kind="stable")
            short.append(Short(np.array([i for i, _ in some])[order], table[order], key[order]))
            continue
        b = blocks(np.concatenate([w for _, w in some]), np.cumsum([0, *(len(w) for _, w in some)]))
        tail = np.append(b.row[1:] != b.row[:-1], True) & (np.bincount(b.row)[b.row] > 1)
        query = windows(b, projection)[~tail]
        table = np.zeros((len(some), kind * _BITS), dtype=np.uint32)
        keys, number, total = [], [], []
        for p, (_, w) in enumerate(some):
            table[p, : len(w)] = w
            unique = np.unique(w)
            rare = unique[np.argsort(-idf[unique & np.uint32(BUCKETS - 1)], kind="stable")][:ANSWER_WORDS]
            keys.append((rare.astype(np.uint64) << np.uint64(32)) | np.uint64(p))
            number.append(np.arange(len(rare)))
            total.append(len(rare))
        answer, number, total = np.concatenate(keys), np.concatenate(number), np.array(total)
        order = np.argsort(answer)
        # An item of 64 words has four passages: a window may be its first (all others follow) or its last.
        reach = kind * _BITS // HALF
        before, after = (reach // 2, reach) if kind == 1 else (reach, reach + 1)
        first = np.searchsorted(b.row[~tail], np.arange(len(some) + 1))
        out.append(Items(query, first, np.array([i for i, _ in some]), table, np.array([len(w) for _, w in some]), answer[order], number[order], np.ceil(ANSWER * total - 1e-9).astype(int), total, before, after))
    return out, short


def lcs(a: np.ndarray, la: np.ndarray, b: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each row of a (n, a multiple of 64; la words of it) and b (n, m; where there), by bit vectors."""
    n, size = a.shape
    words = size // _BITS
    one, ones = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    v = np.full((n, words), ones)
    bit = one << np.arange(_BITS, dtype=np.uint64)
    inside = np.arange(size) < la[:, None]
    for j in range(b.shape[1]):
        m = (((a == b[:, j : j + 1]) & inside & there[:, j : j + 1]).reshape(n, words, _BITS) * bit).sum(axis=2, dtype=np.uint64)
        u = v & m
        rest, carry = v - u, np.zeros(n, dtype=np.uint64)
        for w in range(words):
            added = v[:, w] + u[:, w]
            over = added < u[:, w]
            added += carry
            carry = (over | (added < carry)).astype(np.uint64)
            v[:, w] = added | rest[:, w]
    kept = np.clip(la[:, None] - np.arange(words) * _BITS, 0, _BITS)
    mask = np.where(kept < _BITS, (one << np.minimum(kept, _BITS - 1).astype(np.uint64)) - one, ones)
    return np.bitwise_count(~v & mask).sum(axis=1, dtype=np.int64)


def _answered(b: Blocks, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, item and number of the item's answer words in the window's region, where these are as many as the item needs."""
    word = (items.answer >> np.uint64(32)).astype(np.uint32)
    flat = b.words.ravel()
    # Most words are no answer of any item: a small table of their low bits tells that at once.
    seen = np.zeros(1 << 16, dtype=bool)
    seen[word & np.uint32(0xFFFF)] = True
    at = np.flatnonzero(seen[flat & np.uint32(0xFFFF)] & (b.bucket.ravel() != BUCKETS))
    lo, hi = np.searchsorted(word, flat[at], side="left"), np.searchsorted(word, flat[at], side="right")
    index = np.repeat(lo, hi - lo) + within(hi - lo)
    count = len(items.item)
    block, item = np.repeat(at // HALF, hi - lo), (items.answer[index] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # An answer word counts for every window whose region holds its block.
    code = np.unique((block * count + item) * ANSWER_WORDS + items.number[index])
    block, item, number = code // ANSWER_WORDS // count, code // ANSWER_WORDS % count, code % ANSWER_WORDS
    spread = np.arange(-items.after + 1, items.before + 1)
    window = (block[:, None] + spread).ravel()
    block, item, number = (np.repeat(x, len(spread)) for x in (block, item, number))
    ok = (window >= 0) & (window < len(b.row))
    ok &= b.row[np.clip(window, 0, len(b.row) - 1)] == b.row[block]
    pair, start = np.unique((window * count + item)[ok], return_inverse=True)
    mask = np.zeros(len(pair), dtype=np.int64)
    np.bitwise_or.at(mask, start, 1 << number[ok])
    found = np.bitwise_count(mask.astype(np.uint64)).astype(np.int64)
    ok = found >= items.need[pair % count] if count else found > 0
    return pair[ok] // count, pair[ok] % count, found[ok]


def _cosines(vectors: np.ndarray, window: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """The largest cosine of each window with a window of the item."""
    out = np.full(len(window), -1.0, dtype=np.float32)
    first, n = items.query_first[item], np.diff(items.query_first)[item]
    for k in range(int(n.max()) if len(n) else 0):
        on = np.flatnonzero(n > k)
        out[on] = np.maximum(out[on], np.einsum("ij,ij->i", vectors[window[on]], items.query[first[on] + k]))
    return out


def search(space: Space, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, item_id, LCS share and answer share of every verified match of the texts' words."""
    b = blocks(ids, first)
    if not len(b.row):
        return
    for s in space.short:
        n = s.words.shape[1]
        key = _run_key(ids, n)
        lo, hi = np.searchsorted(s.key, key, side="left"), np.searchsorted(s.key, key, side="right")
        at, which = np.repeat(np.arange(len(key)), hi - lo), np.repeat(lo, hi - lo) + within(hi - lo)
        row = np.searchsorted(first, at, side="right") - 1
        ok = (at + n <= first[row + 1]) & (ids[at[:, None] + np.arange(n)] == s.words[which]).all(axis=1)
        yield row[ok], s.item[which[ok]], np.ones(int(ok.sum())), np.ones(int(ok.sum()))
    vectors = windows(b, space.projection) if space.groups else None
    for items in space.groups:
        block, item, found = _answered(b, items)
        near = _cosines(vectors, block, item, items) >= COSINE
        block, item, found = block[near], item[near], found[near]
        step = max(1, 262_144 // items.words.shape[1])
        for lo in range(0, len(block), step):
            k, p = block[lo : lo + step], item[lo : lo + step]
            around = k[:, None] + np.arange(-items.before, items.after)
            at = np.clip(around, 0, len(b.row) - 1)
            there = (at == around) & (b.row[at] == b.row[k][:, None])
            region = b.words[at].reshape(len(k), -1)
            inside = np.repeat(there, HALF, axis=1) & (b.bucket[at].reshape(len(k), -1) != BUCKETS)
            share = lcs(items.words[p], items.length[p], region, inside) / items.length[p]
            good = share >= LCS
            yield b.row[k[good]], items.item[p[good]], share[good], (found[lo : lo + step] / items.total[p])[good]


def fit(words: DataFrame, benchmark: DataFrame) -> Iterator[Space]:
    """The latent space of all passages, with the items in it slice by slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(BUCKETS + 1)
        for batch in batches:
            b = blocks(*unblob(batch.column(0), np.uint32))
            total[:BUCKETS] += passages_with(b.bucket)
            total[BUCKETS] += len(b.row)
        return total

    counts = summed(words.select("words"), count, BUCKETS + 1)
    idf = np.append(np.log((counts[BUCKETS] + 1) / (counts[:BUCKETS] + 1)), 0.0).astype(np.float32)
    g = gaussian()

    def project(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        basis = gaussian()
        y, weighted = np.zeros_like(basis), basis * idf[:, None]
        for batch in batches:
            sketch(blocks(*unblob(batch.column(0), np.uint32)).bucket, idf, weighted, y)
        return y[:BUCKETS].ravel()

    y = summed(words.select("words"), project, BUCKETS * RANK).reshape(BUCKETS, RANK) * idf[:BUCKETS, None]
    u, s = factor(y, g[:BUCKETS]) if counts[BUCKETS] else (np.zeros((BUCKETS, 1)), np.ones(1))
    projection = (np.append(u / s, np.zeros((1, u.shape[1])), axis=0) * idf[:, None]).astype(np.float32)
    rows = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator()
    while held := list(islice(rows, SLICE)):
        hashes = [w.hash[a:z].astype(np.uint32) for _, _, w in scan(pa.array([r.text for r in held], pa.string())) for a, z in zip(w.first[:-1], w.first[1:])]
        yield Space(projection, *prepare([r.item_id for r in held], hashes, idf, projection))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs (largest share of the item in sequence) and answer (largest share of its rarest words) of every match."""
    words = tokenised(docs)
    context = docs.sparkSession.sparkContext
    item = benchmark.schema["item_id"].dataType
    kind = words.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item.simpleString()}, lcs double, answer double"

    def over(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, items, share, answer in search(held.value, *unblob(batch.column(1), np.uint32)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(items), pa.array(share), pa.array(answer)], names=["doc_id", "item_id", "lcs", "answer"])

        return words.select("doc_id", "words").mapInArrow(run, schema)

    found = docs.sparkSession.createDataFrame([], schema)
    for space in fit(words, benchmark):
        found = found.unionByName(over(context.broadcast(space)))
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("lcs"), 4).alias("lcs"), F.round(F.max("answer"), 4).alias("answer"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with their own columns: each batch is filtered where it is searched."""
    words = tokenised(docs)
    at = docs.columns.index("text")

    def over(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), dtype=bool)
                for lo, _, w in scan(batch.column(at)):
                    for row, *_ in search(held.value, w.hash.astype(np.uint32), w.first):
                        keep[lo + row] = False
                yield batch.filter(pa.array(keep))

        return run

    kept = docs
    for space in fit(words, benchmark):
        kept = mapped(kept, over(docs.sparkSession.sparkContext.broadcast(space)))
    return kept
