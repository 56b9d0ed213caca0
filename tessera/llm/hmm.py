"""Scoring by a hidden Markov language model: Baum-Welch over all documents, exact likelihood by the scaled forward recursion.

The model has `states` latent states and an emission probability of its own for every word of the corpus (words are told apart
by 64-bit hashes; a model given `buckets` folds them, for comparison). The vocabulary is never held in one place:

1. Documents are laid into blocks of about BLOCK words, each with the list of its distinct words. A block lies and travels in rows of
   SLICE words, packed, so the JVM, which copies whole rows at every step, never has a large one; Python puts a block together.
2. A block runs the forward and backward recursions over all its words (one matrix step for all documents that are still
   running) and sends its expected counts keyed by word to the word's part; the number of parts follows from the number of words.
3. A part adds up the counts of its words over all blocks and sends the sums back to the blocks that hold the words.

What is gathered therefore grows with the distinct words and with the input; the driver gets the sums over states only.

Texts are whole sequences in training and in scoring, however long. Of a text too long to hold all its forward probabilities, those at
the head of every stretch of STRETCH words are kept; the backward recursion goes from stretch to stretch, recomputes the forward
probabilities of each and carries its own on, so counts are those of the whole text.

Defined results: null, empty and wordless texts have n_words 0, log_likelihood 0.0 and null perplexity; repeated rows are
trained on and scored each; a null doc_id stays null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _remove as removed
from .common import mix, scan, stored, within

STATES = 8
ITERATIONS = 3
#: Words of a block, and words (counted once for each block that holds them) of a part.
BLOCK, PART = 4_000_000, 500_000
#: Words of a row of a block; its cells stay below half a region of a small heap, from where on the JVM sets memory aside for each.
SLICE = 1 << 17
#: Bytes of an Arrow batch; the JVM sets aside memory outside its heap for each, which it gives back late or never.
BATCH = 1 << 20
#: The cells are packed already, so Parquet neither compresses them nor gathers 100 rows, its default, before it looks at a page's size.
PAGES = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.page.size.check.estimate": "false"}
#: Words whose forward probabilities are held at once.
STRETCH = 600_000
CHUNK = 300_000
#: Added to expected counts, so every sequence has a likelihood above 0.
SMOOTH = 0.01


class Model(NamedTuple):
    pi: np.ndarray  # (K,)
    a: np.ndarray  # (K, K), rows sum to 1
    e: np.ndarray  # (B, K), columns sum to 1


class Lanes(NamedTuple):
    """Sequences side by side, longest first: step t holds word t of the first width[t] of them."""

    order: np.ndarray
    width: np.ndarray
    start: np.ndarray
    source: np.ndarray  # index of each word in the flat input
    lane: np.ndarray


def lanes(first: np.ndarray, lengths: np.ndarray) -> Lanes:
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    order, sizes = order[sizes > 0], sizes[sizes > 0]
    steps = int(sizes[0]) if len(sizes) else 0
    width = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")
    start = np.cumsum(width) - width
    lane, t = np.repeat(np.arange(len(sizes)), sizes), within(sizes)
    to = start[t] + lane
    source, lane_at = np.empty(len(to), dtype=np.int64), np.empty(len(to), dtype=np.int64)
    source[to] = np.repeat(first[order], sizes) + t
    lane_at[to] = lane
    return Lanes(order, width, start, source, lane_at)


def forward(m: Model, obs: np.ndarray, lay: Lanes, alpha: np.ndarray | None, t0: int = 0, t1: int | None = None, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scales of the words of steps t0 to t1 (their logarithms add up to the likelihood) and the last forward probabilities.

    head: forward probabilities of the step before t0; alpha: filled, where it is given, with those of each word.
    """
    kind = m.e.dtype
    t1 = len(lay.start) if t1 is None else t1
    base = int(lay.start[t0]) if t0 < t1 else 0
    scale, ones = np.empty(int(lay.start[t1 - 1] + lay.width[t1 - 1]) - base if t0 < t1 else 0, dtype=kind), np.ones(len(m.pi), dtype=kind)
    a = np.zeros((0, len(m.pi)), dtype=kind) if head is None else head
    block, at = None, 0
    for t, lo, n in zip(range(t0, t1), lay.start[t0:t1].tolist(), lay.width[t0:t1].tolist()):
        if block is None or lo + n > at + len(block):
            at = lo
            block = m.e[obs[lo : lo + max(n, CHUNK)]]
        e = block[lo - at : lo - at + n]
        a = (a[:n] @ m.a) * e if t else m.pi * e
        c = a @ ones
        a *= (1 / c)[:, None]
        scale[lo - base : lo - base + n] = c
        if alpha is not None:
            alpha[lo - base : lo - base + n] = a
    return scale, a


def expected(m: Model, obs: np.ndarray, lay: Lanes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected transitions and starts, and the log-likelihood; adds expected emissions to counts (K, B)."""
    k, kind = len(m.pi), m.e.dtype
    # Stretches of steps; the forward probabilities at their heads are kept.
    cuts = [0, *(np.flatnonzero(np.diff(lay.start // STRETCH)) + 1).tolist(), len(lay.start)]
    heads: list[np.ndarray | None] = [None]
    for lo, hi in zip(cuts[:-2], cuts[1:-1]):
        heads.append(forward(m, obs, lay, None, lo, hi, heads[-1])[1])
    xi, back, total = np.zeros((k, k)), np.ones((0, k), dtype=kind), 0.0
    turned = np.ascontiguousarray(m.a.T)
    first = np.zeros(k)
    for part in range(len(cuts) - 2, -1, -1):
        t0, t1 = cuts[part], cuts[part + 1]
        base, end = int(lay.start[t0]), int(lay.start[t1 - 1] + lay.width[t1 - 1])
        alpha = np.empty((end - base, k), dtype=kind)
        scale, _ = forward(m, obs, lay, alpha, t0, t1, heads[part])
        total += float(np.log(scale.astype(np.float64)).sum())
        over = m.e[obs[base:end]]
        over *= (1 / scale)[:, None]
        starts, widths = (lay.start[t0:t1] - base).tolist(), lay.width[t0:t1].tolist()
        for t in range(t1 - t0 - 1, -1, -1):
            lo, n = starts[t], widths[t]
            if len(back) < n:
                back = np.concatenate([back, np.ones((n - len(back), k), dtype=kind)])
            if t or t0:
                x = over[lo : lo + n]
                x *= back
                before = alpha[starts[t - 1] : starts[t - 1] + n] if t else heads[part][:n]
                xi += before.T @ x
                alpha[lo : lo + n] *= back
                back = x @ turned
            else:
                alpha[lo : lo + n] *= back
                first = alpha[:n].sum(axis=0, dtype=np.float64)
        del over
        for j in range(k):
            counts[j] += np.bincount(obs[base:end], alpha[:, j], minlength=counts.shape[1])
    return xi * m.a, first, total


def chunks(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, begin and length of sequences in chunks of about CHUNK words, alike in length."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    cut = np.cumsum(lengths) // CHUNK
    for lo, hi in zip(np.flatnonzero(np.diff(cut, prepend=-1)), np.append(np.flatnonzero(np.diff(cut)) + 1, len(cut))):
        yield order[lo:hi], begin[lo:hi], lengths[lo:hi]


def _pack(x: np.ndarray) -> bytes:
    """Without loss: the values' bytes by place, of which the upper ones are alike, packed."""
    planes = np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return x.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _cut(table: pa.Table) -> pa.Table:
    """The same rows in batches of about BATCH bytes."""
    return pa.Table.from_batches(table.to_batches(max_chunksize=max(1, len(table) * BATCH // max(1, table.nbytes))), table.schema)


class Fitted(NamedTuple):
    """A model whose emissions lie in the shared folder: `sums` has the expected counts of each block's words, by block and part."""

    pi: np.ndarray  # (K,)
    a: np.ndarray  # (K, K), rows sum to 1
    sums: DataFrame | None  # block, part, sums; none: the first emissions, which a word's hash tells
    total: np.ndarray  # (K,) sums over all words
    buckets: int
    parts: int


def _noise(words: np.ndarray, states: int) -> np.ndarray:
    """(words, states): the first emissions, near-uniform, told apart by noise that depends on word and state alone."""
    ids = mix(words)[:, None] + np.arange(states, dtype=np.uint64)
    return 0.5 + mix(ids + np.uint64(0x5851F42D4C957F2D)).astype(np.float64) / 2.0**64


def _block_rows(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([x for x, *_ in held])
            lengths = np.concatenate([n for _, n, *_ in held]).astype(np.int64)
            words, place = np.unique(np.concatenate([w for _, _, w, _ in held]), return_inverse=True)
            place = np.split(place.astype(np.uint32), np.cumsum([len(w) for _, _, w, _ in held])[:-1])
            obs = np.concatenate([p[x] for p, (*_, x) in zip(place, held)])
            n = np.bincount(obs, minlength=len(words))
            # Frequent words get small numbers, so the upper bytes are nearly all 0 and pack well.
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            obs, words = rank[obs], words[order]
            pieces = max(1, -(-max(len(obs), len(ids)) // SLICE))
            at = 0
            for i, (w, n, x) in enumerate(zip(*(np.array_split(x, pieces) for x in (words, lengths, obs)))):
                own = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), ids.slice(at, len(n)))
                at += len(n)
                columns = [pa.array([number], pa.int64()), pa.array([i], pa.int32()), own, *(pa.array([x], pa.binary()) for x in (w.tobytes(), _pack(n), _pack(x)))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "piece", "ids", "vocabulary", "lengths", "words"])

        for batch in batches:
            for lo, hi, words in scan(batch.column(1)):
                own, place = np.unique(words.hash, return_inverse=True)
                held.append((batch.column(0).slice(lo, hi - lo), np.diff(words.first), own, place.astype(np.uint32)))
                if sum(len(x) for *_, x in held) >= BLOCK:
                    yield from packed()
                    number, held[:] = number + 1, []
        if held:
            yield from packed()

    return run, f"block long, piece int, ids array<{kind}>, vocabulary binary, lengths binary, words binary"


def tokenised(docs: DataFrame) -> DataFrame:
    """The documents in blocks, in the shared folder: doc_ids, distinct words, and the words as numbers of these, each block in pieces."""
    return stored(docs.select("doc_id", "text").mapInArrow(*_block_rows(docs.schema["doc_id"].dataType.simpleString())), "blocks", PAGES)


class _Block(NamedTuple):
    number: int
    ids: pa.Array
    obs: np.ndarray  # numbers of keys
    first: np.ndarray
    keys: np.ndarray  # distinct words, by part
    cuts: np.ndarray  # where each part begins and ends


def _by_part(words: np.ndarray, buckets: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of words by part, where each part begins and ends, and the place of each word's key."""
    keys, number = np.unique(words % np.uint64(buckets) if buckets else words, return_inverse=True)
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return keys[order], np.searchsorted(part[order], np.arange(parts + 1)), place[number]


def _block(rows: pa.Table, buckets: int, parts: int) -> _Block:
    """A block from its pieces, which come in any order."""
    order = np.argsort(rows.column("piece").to_numpy())
    each = lambda name: (rows.column(name)[i] for i in order.tolist())
    keys, cuts, place = _by_part(np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in each("vocabulary")]), buckets, parts)
    obs = np.concatenate([place[_unpack(x.as_py(), np.uint32)] for x in each("words")])
    lengths = np.concatenate([_unpack(x.as_py(), np.int64) for x in each("lengths")])
    return _Block(rows.column("block")[0].as_py(), pa.concat_arrays([x.values for x in each("ids")]), obs, np.concatenate([[0], np.cumsum(lengths)]), keys, cuts)


_SENT, _SUMS = "part long, block long, words binary, counts binary", "block long, part long, sums binary"


def _sent(block: int, keys: np.ndarray, cuts: np.ndarray, counts: np.ndarray, stats: np.ndarray | None) -> pa.Table:
    """A block's counts (words, K) by part, and at part -1 what else it adds up."""
    at = np.flatnonzero(np.diff(cuts))
    rows = [(int(p), _pack(keys[cuts[p] : cuts[p + 1]]), _pack(counts[cuts[p] : cuts[p + 1]].astype(np.float32))) for p in at]
    if stats is not None:
        rows.append((-1, b"", stats.tobytes()))
    return _cut(pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "words": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())}))


def _add(k: int):
    """Sums of each word of a part, for every block that has it; at block -1 the sums over all words."""

    def run(table: pa.Table) -> pa.Table:
        part, counts = table.column("part")[0].as_py(), [x.as_py() for x in table.column("counts")]
        if part < 0:
            rows = [(-1, sum(np.frombuffer(x) for x in counts).tobytes())]
        else:
            each = [_unpack(x.as_py(), np.uint64) for x in table.column("words")]
            keys, where = np.unique(np.concatenate(each), return_inverse=True)
            flat = np.concatenate([_unpack(x, np.float32) for x in counts]).reshape(-1, k)
            sums = np.stack([np.bincount(where, flat[:, j], minlength=len(keys)) for j in range(k)], axis=1) + SMOOTH
            back = np.split(sums.astype(np.float32)[where], np.cumsum([len(x) for x in each])[:-1])
            rows = [(b.as_py(), _pack(x)) for b, x in zip(table.column("block"), back)] + [(-1, sums.sum(axis=0).tobytes())]
        return _cut(pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int64()), "sums": pa.array([r[1] for r in rows], pa.binary())}))

    return run


def _first_total(k: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([_unpack(x.as_py(), np.uint64) for x in table.column("words")]))
        return pa.table({"block": pa.array([-1], pa.int64()), "part": table.column("part").slice(0, 1), "sums": pa.array([_noise(keys, k).sum(axis=0).tobytes()], pa.binary())})

    return run


def _emissions(b: _Block, m: Fitted, sums: pa.Table | None, kind: type) -> np.ndarray:
    """(words, K): probabilities of the block's words, of the given precision."""
    out = np.empty((len(b.keys), len(m.pi)), dtype=kind)
    total = m.total.astype(kind)
    if sums is None:
        for lo in range(0, len(out), CHUNK):
            np.divide(_noise(b.keys[lo : lo + CHUNK], len(m.pi)), total, out=out[lo : lo + CHUNK], casting="same_kind")
        return out
    blob = sums.column("sums")
    # Parts come one by one, so there is never a second table of all words.
    for i, part in enumerate(sums.column("part").to_pylist()):
        lo, hi = b.cuts[part], b.cuts[part + 1]
        np.divide(_unpack(blob[i].as_py(), np.float32).reshape(-1, len(m.pi)), total, out=out[lo:hi])
    return out


def _over(words: DataFrame, m: Fitted, each, schema: str) -> DataFrame:
    """each(rows, sums) for every block, met by the sums of its words."""
    if m.sums is None:
        return words.groupBy("block").applyInArrow(lambda rows: each(rows, None), schema)
    return words.groupBy("block").cogroup(m.sums.where("block >= 0").groupBy("block")).applyInArrow(each, schema)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """stored(); the shuffles that led to it go at once, so what lies on disk does not add up over iterations."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df, name, PAGES)
    finally:
        conf.set(key, before)


def _drop(df: DataFrame | None) -> None:
    """Removes what _kept() wrote, once nothing reads it again."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()} if df is not None else ():
        removed(df.sparkSession, path)


def _totals(df: DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums over all words, and what part -1 has."""
    rows = {r.part: np.frombuffer(bytes(r.sums)) for r in df.where("block = -1").collect()}
    rest = rows.pop(-1, None)
    return sum(rows[p] for p in sorted(rows)) if rows else np.ones(1), rest


def initial(words: DataFrame, states: int, buckets: int) -> Fitted:
    held = words.agg(F.sum(F.length("vocabulary"))).first()[0] or 0
    parts = max(1, -(-held // (8 * PART)))
    nothing = np.zeros((0, 0))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, cuts, _ = _by_part(np.frombuffer(words.as_py(), dtype=np.uint64), buckets, parts)
                yield from _sent(block, keys, cuts, nothing, None).to_batches()

    total, _ = _totals(words.select("block", "vocabulary").mapInArrow(send, _SENT).groupBy("part").applyInArrow(_first_total(states), _SUMS))
    a = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
    return Fitted(np.full(states, 1 / states), a, None, total, buckets, parts)


def iterate(words: DataFrame, m: Fitted) -> tuple[Fitted, float]:
    """One Baum-Welch iteration over all words: the next model, and the log-likelihood under m."""
    k = len(m.pi)
    plain = m._replace(sums=None)

    def count(rows: pa.Table, sums: pa.Table | None) -> pa.Table:
        b = _block(rows, plain.buckets, plain.parts)
        # Training needs no more than single precision; scores are computed in double.
        model = Model(plain.pi.astype(np.float32), plain.a.astype(np.float32), _emissions(b, plain, sums, np.float32))
        counts = np.zeros((k, len(b.keys)))
        xi, starts, total = np.zeros((k, k)), np.zeros(k), 0.0
        for _, begin, lengths in chunks(b.first):
            lay = lanes(begin, lengths)
            if len(lay.order):
                x, s, ll = expected(model, b.obs[lay.source], lay, counts)
                xi, starts, total = xi + x, starts + s, total + ll
        del model
        return _sent(b.number, b.keys, b.cuts, counts.T, np.concatenate([xi.ravel(), starts, [total]]))

    counts = _kept(_over(words, m, count, _SENT), "counts")
    sums = _kept(counts.groupBy("part").applyInArrow(_add(k), _SUMS), "sums")
    _drop(counts)
    total, rest = _totals(sums)
    if rest is None:
        return m, 0.0
    xi, starts = rest[: k * k].reshape(k, k) + SMOOTH, rest[k * k : -1] + SMOOTH
    return m._replace(pi=starts / starts.sum(), a=xi / xi.sum(axis=1, keepdims=True), sums=sums, total=total), float(rest[-1])


def train(words: DataFrame, states: int = STATES, iterations: int = ITERATIONS, buckets: int = 0) -> tuple[Fitted, list[float]]:
    """The model, and the corpus log-likelihood before each iteration; buckets: fold words into so many (0: every word its own)."""
    m, history = initial(words, states, buckets), []
    for _ in range(iterations):
        last = m
        m, before = iterate(words, m)
        history.append(before)
        if m is not last:
            _drop(last.sums)
    return m, history


def likelihood(m: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Exact log-likelihood of each sequence; 0.0 for empty ones."""
    out = np.zeros(len(first) - 1)
    for row, begin, lengths in chunks(first):
        lay = lanes(begin, lengths)
        if len(lay.order):
            scale, _ = forward(m, ids[lay.source] % len(m.e), lay, None)
            out[row[lay.order]] = np.bincount(lay.lane, np.log(scale), minlength=len(lay.order))
    return out


def score(words: DataFrame, m: Fitted) -> DataFrame:
    plain = m._replace(sums=None)

    def run(rows: pa.Table, sums: pa.Table | None) -> pa.Table:
        b = _block(rows, plain.buckets, plain.parts)
        found = likelihood(Model(plain.pi, plain.a, _emissions(b, plain, sums, np.float64)), b.obs, b.first)
        return pa.table({"doc_id": b.ids, "n_words": pa.array(np.diff(b.first)), "ll": pa.array(found)})

    kind = words.schema["ids"].dataType.elementType.simpleString()
    out = _over(words, m, run, f"doc_id {kind}, n_words long, ll double")
    return out.select("doc_id", "n_words", F.round("ll", 4).alias("log_likelihood"), F.when(F.col("n_words") > 0, F.round(F.exp(-F.col("ll") / F.col("n_words")), 4)).alias("perplexity"))


def language_model_scores(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, n_words, log_likelihood and perplexity (by word) of each document under a model of all documents."""
    words = tokenised(docs)
    m, _ = train(words, states, iterations)
    return score(words, m)
