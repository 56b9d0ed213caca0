"""Repeated passages by suffix arrays: sharded arrays, common prefixes, and a merge of shards by binary search.

A passage repeats where SPAN or more words in a row occur at two places of the corpus (in one document or in two).

1. Anchors. Of every SPAN words in a row, the GRAM-word sequence with the smallest hash is an anchor, so two equal passages have an
   anchor in common. Anchors are counted over the corpus; only documents with one that occurs twice go on, and only the words
   within reach of such an anchor (its region) can belong to a repeat. Nothing that repeats is lost, and no cap applies.
2. Shards. Regions are collected to shards of about SHARD words. A shard's suffix array is built by Larsson-Sadakane refinement: suffixes
   are sorted by their first h words, then unsorted groups alone by (rank, rank h words on) with h doubled. Kasai's walk gives the
   common prefix of neighbours; it runs in many lanes at once, each over its own stretch of text. Neighbours that share SPAN
   words form classes of equal windows; these alone tell what repeats inside the shard.
3. Merge. Every shard sends a 64-bit key of its words and its first document for each class, sorted, in ranges of the key space (as many
   as the number of words asks for). Where a range meets, keys of several shards are found by binary search in the merged order, and
   each shard gets back, as bits, which of its classes repeat elsewhere and which of them it holds first. Between shards equal keys
   stand for equal windows: sending the words would multiply what moves by ten. Of 10**12 different windows some 30,000 would
   share a key with another.
4. Spans. Windows that repeat in the shard or elsewhere are joined to maximal spans.

Of all equal windows the one in the smallest doc_id (then the one furthest to the front) is the first, every other a copy. Where doc_id
is no integer, documents are ordered by its hash.

Defined results: null, empty and short texts (under SPAN words) have no spans; rows that agree in doc_id and text count once; a null
doc_id sorts last; extra columns are ignored; an empty table gives an empty result. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import blobs, mix, powers, scan, stored, within

SPAN, GRAM = 50, 25
SHARD = 1_000_000
#: Words for each range of the key space.
PART = 4_000_000
LANES = 4096
_LAST = np.iinfo(np.int64).max


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position on; positions too near the end are left out."""
    n = len(words)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(up[:n] * mix(words.astype(np.uint64) + np.uint64(1)), out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1])


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over x[i:i + width] for each i that has so many; by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors in the texts' words, and their hashes."""
    g = grams(words, GRAM)
    width = SPAN - GRAM + 1
    if len(g) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    g = np.maximum(g, np.uint64(1))
    low = _slide(g, width, np.minimum)
    # A window of SPAN words must lie in one text; others count as 0 and choose nothing.
    left = np.repeat(first[1:], np.diff(first))[: len(low)] - np.arange(len(low))
    low[left < SPAN] = 0
    padded = np.concatenate([np.zeros(width - 1, dtype=np.uint64), low, np.zeros(len(g) - len(low), dtype=np.uint64)])
    at = np.flatnonzero(_slide(padded, width, np.maximum)[: len(g)] == g)
    return at, g[at]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of text (non-negative integers), by Larsson-Sadakane refinement."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.concatenate([[True], text[order][1:] != text[order][:-1]]) if n else np.zeros(0, dtype=bool)
    # The rank of a group is the place of its first suffix.
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, sizes)
    open_ = np.repeat(sizes > 1, sizes)
    places = np.flatnonzero(open_)  # places of the order whose group is not yet sorted
    h = 1
    while len(places):
        suffix = order[places]
        group = rank[suffix]
        following = rank[np.minimum(suffix + h, n)]
        by = np.argsort(group * np.int64(n + 1) + following + 1, kind="stable")
        suffix, group, following = suffix[by], group[by], following[by]
        order[places] = suffix
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(suffix)))
        rank[suffix] = np.repeat(places[starts], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Common prefix of each suffix in the order with the one before it (0 for the first), by Kasai's walk in many lanes.

    A lane walks its stretch of the text from left to right. In each step it either finds one more word equal, or notes the
    length found and moves on by one word, of which all but one of the words found stay found.
    """
    n = len(text)
    before = np.empty(n, dtype=np.int64)
    before[order[1:]] = order[:-1]
    if n:
        before[order[0]] = -1
    found = np.zeros(n, dtype=np.int64)
    ended = np.append(text, -1)
    lanes = max(1, min(lanes, n // 64))
    cut = np.linspace(0, n, lanes + 1).astype(np.int64)
    at, end = cut[:-1].copy(), cut[1:]
    have = np.zeros(lanes, dtype=np.int64)
    alive = np.flatnonzero(at < end)
    at, end, have = at[alive], end[alive], have[alive]
    while len(at):
        other = before[at]
        a, b = at + have, other + have
        same = (other >= 0) & (a < n) & (b < n)
        same &= ended[np.minimum(a, n)] == ended[np.minimum(b, n)]
        stop = ~same
        found[at[stop]] = have[stop]
        have = np.where(same, have + 1, np.maximum(have - 1, 0))
        at = at + stop
        if (at == end).any():
            on = at < end
            at, end, have = at[on], end[on], have[on]
    return found[order]


def classes(words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For regions one after another: positions of all windows of SPAN words in a region, and the class of each (equal windows share one)."""
    lengths = np.maximum(length - SPAN + 1, 0)
    start = np.cumsum(length) - length
    # A separator of its own after each region ends every common prefix there.
    value = np.unique(words, return_inverse=True)[1] + len(length)
    text = np.empty(len(words) + len(length), dtype=np.int64)
    to = np.arange(len(words)) + np.repeat(np.arange(len(length)), length)
    text[to] = value
    text[np.cumsum(length) + np.arange(len(length))] = np.arange(len(length))
    order = suffix_array(text)
    prefix = common_prefixes(text, order)
    number = np.empty(len(text), dtype=np.int64)
    number[order] = np.cumsum(prefix < SPAN)
    position = np.repeat(start, lengths) + within(lengths)
    return position, number[to[position]]


def regions(first: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin and length (words) of the stretches within reach of the hot positions; overlapping ones are one."""
    row = np.searchsorted(first, hot, side="right") - 1
    lo = np.maximum(first[row], hot - (SPAN - GRAM))
    hi = np.minimum(first[row + 1], hot + SPAN)
    top = np.maximum.accumulate(hi) if len(hi) else hi
    new = np.concatenate([[True], (lo[1:] > top[:-1]) | (row[1:] != row[:-1])]) if len(hi) else np.zeros(0, dtype=bool)
    starts = np.flatnonzero(new)
    begin, end = lo[starts], top[np.append(starts[1:], len(hi)) - 1] if len(starts) else top
    return row[starts], begin, end - begin


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for lo, _, words in scan(batch.column(1)):
            at, h = anchors(words.hash, words.first)
            row = np.searchsorted(words.first, at, side="right") - 1
            # Twice in one text is a repeat by itself.
            pair, n = np.unique(np.stack([h, (lo + row).astype(np.uint64)], axis=1), axis=0, return_counts=True) if len(h) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64)), pa.array(keys[pair[:, 1].astype(np.int64)]), pa.array(np.minimum(n, 2).astype(np.int32))], names=["h", "key", "n"])


_STATE = "shard long, ids array<{kind}>, order binary, doc binary, begin binary, length binary, words binary, local binary, number binary"


def _state(shard: int, ids: list, order: list, doc: np.ndarray, begin: np.ndarray, length: np.ndarray, words: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """A shard: its documents and regions, which windows repeat in it (local), and of these the class (number)."""
    position, number = classes(words, length)
    local = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, dtype=bool)
    cells = (np.array(order, dtype=np.int64), doc.astype(np.int32), begin.astype(np.int32), length.astype(np.int32), words.astype(np.uint32), np.packbits(local), number[local].astype(np.int32))
    row = [pa.array([shard], pa.int64()), pa.array([ids], pa.list_(kind)), *(pa.array([x.tobytes()], pa.binary()) for x in cells)]
    return pa.RecordBatch.from_arrays(row, names=["shard", "ids", "order", "doc", "begin", "length", "words", "local", "number"])


def _shards(kind: pa.DataType):
    return lambda batches: _each_shard(batches, kind)


def _each_shard(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows key, doc_id, text, order, hot (array of anchor hashes), all of one key together: the shards' states."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 32
    ids: list = []
    order: list = []
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        return _state(shard, ids, order, *(np.concatenate(x) for x in zip(*held)), kind)

    for batch in batches:
        keys = batch.column(0).to_numpy()
        fresh = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, dtype=bool)
        last = keys[-1] if len(keys) else last
        batch = batch.filter(pa.array(fresh))
        hot_lists = batch.column(4)
        for lo, hi, words in scan(batch.column(2)):
            g = grams(words.hash, GRAM)
            hot = np.unique(hot_lists.slice(lo, hi - lo).flatten().to_numpy().view(np.uint64))
            if not len(hot):
                continue
            position = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g)
            row = np.searchsorted(words.first, position, side="right") - 1
            position = position[position + GRAM <= words.first[row + 1]]
            text, begin, length = regions(words.first, position)
            long = length >= SPAN
            text, begin, length = text[long], begin[long], length[long]
            if not len(text):
                continue
            used, doc = np.unique(text, return_inverse=True)
            take = np.repeat(begin, length) + within(length)
            held.append((doc + len(ids), begin - words.first[text], length, words.hash[take].astype(np.uint32)))
            ids.extend(batch.column(1).take(pa.array(used + lo)).to_pylist())
            order.extend(batch.column(3).take(pa.array(used + lo)).to_pylist())
            size += int(length.sum())
            if size >= SHARD:
                yield flush()
                ids, order, held, size, shard = [], [], [], 0, shard + 1
    if held:
        yield flush()


class _Windows:
    """All windows of a shard's state, with their classes; the classes in the order of their keys, each with its first window and document."""

    def __init__(self, state: dict) -> None:
        raw = {k: np.frombuffer(state[k], dtype=t) for k, t in (("doc", np.int32), ("begin", np.int32), ("length", np.int32), ("words", np.uint32), ("order", np.int64), ("number", np.int32))}
        length = raw["length"].astype(np.int64)
        lengths = np.maximum(length - SPAN + 1, 0)
        start = np.cumsum(length) - length
        position = np.repeat(start, lengths) + within(lengths)
        doc = np.repeat(raw["doc"], lengths).astype(np.int64)
        self.ids, self.row, self.at = state["ids"], doc, np.repeat(raw["begin"], lengths) + within(lengths)
        self.local = np.unpackbits(np.frombuffer(state["local"], dtype=np.uint8), count=len(position)).astype(bool)
        # Windows without an equal one in the shard are classes of their own.
        number = np.arange(len(position))
        number[self.local] = raw["number"].astype(np.int64) + len(position)
        # First of equal windows: smallest doc_id, then the text's place in the shard, then its position.
        place = np.empty(len(self.ids), dtype=np.int64)
        place[np.argsort(raw["order"], kind="stable")] = np.arange(len(self.ids))
        by = np.lexsort((self.at, place[doc], number))
        new = np.concatenate([[True], number[by][1:] != number[by][:-1]]) if len(by) else np.zeros(0, dtype=bool)
        leader = by[new]
        key = grams(raw["words"], SPAN)[position[leader]] if len(leader) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(key, kind="stable")
        self.leader, self.keys = leader[order], key[order]
        self.owner = raw["order"][doc[self.leader]]
        self.number = np.empty(len(by), dtype=np.int64)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.number[by] = rank[np.cumsum(new) - 1]

    def ranges(self, parts: int) -> np.ndarray:
        edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, edges), [len(self.keys)]])


def _send(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in batch.to_pylist():
                w = _Windows(state)
                first = w.ranges(parts)
                used = np.flatnonzero(np.diff(first))
                bounds = np.append(first[used], first[-1])
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), state["shard"])), blobs(w.keys, bounds), blobs(w.owner, bounds)], names=["part", "shard", "keys", "owners"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    """For each shard's keys of one range, in their order: bits of those that other shards hold too, and of those it holds first."""
    table = table.sort_by("shard")
    runs = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("keys")]
    owners = [np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("owners")]
    keys, owner = np.concatenate(runs), np.concatenate(owners)
    source = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    by = np.lexsort((source, owner, keys))
    new = np.concatenate([[True], keys[by][1:] != keys[by][:-1]]) if len(by) else np.zeros(0, dtype=bool)
    starts = np.flatnonzero(new)
    # Of two shards at least: classes of one shard differ, whatever their keys.
    several = source[by][starts] != np.maximum.reduceat(source[by], starts) if len(by) else np.zeros(0, dtype=bool)
    several |= source[by][starts] != np.minimum.reduceat(source[by], starts) if len(by) else several
    merged, winner = keys[by][starts][several], source[by][starts][several]
    shared, first = [], []
    for i, run in enumerate(runs):
        j = np.minimum(np.searchsorted(merged, run), max(len(merged) - 1, 0))
        hit = merged[j] == run if len(merged) else np.zeros(len(run), dtype=bool)
        shared.append(np.packbits(hit).tobytes())
        first.append(np.packbits(~hit | (winner[j] == i if len(merged) else False)).tobytes())
    return pa.table({"shard": table.column("shard"), "part": table.column("part"), "shared": pa.array(shared, pa.binary()), "first": pa.array(first, pa.binary())})


def _runs(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end (words) of windows (sorted by row and position) joined where they touch or overlap."""
    if not len(row):
        return row, at, at
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + SPAN)])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(row)) - 1
    return row[starts], at[starts], at[ends] + SPAN


def _spans(parts: int, kind: pa.DataType):
    def run(states: pa.Table, bits: pa.Table) -> pa.Table:
        out: list[tuple] = []
        every: list = []
        for state in states.to_pylist():
            w = _Windows(state)
            first = w.ranges(parts)
            shared, leads = np.zeros(len(w.keys), dtype=bool), np.ones(len(w.keys), dtype=bool)
            for b in bits.to_pylist():
                lo, hi = first[b["part"]], first[b["part"] + 1]
                shared[lo:hi] = np.unpackbits(np.frombuffer(b["shared"], dtype=np.uint8), count=hi - lo)
                leads[lo:hi] = np.unpackbits(np.frombuffer(b["first"], dtype=np.uint8), count=hi - lo)
            repeats = w.local | shared[w.number]
            is_first = np.zeros(len(w.row), dtype=bool)
            is_first[w.leader] = leads
            for copy in (False, True):
                chosen = np.flatnonzero(repeats & (is_first != copy))
                chosen = chosen[np.lexsort((w.at[chosen], w.row[chosen]))]
                row, lo, hi = _runs(w.row[chosen], w.at[chosen])
                out.append((row + len(every), lo, hi, np.full(len(row), copy)))
            every += w.ids
        row, lo, hi, copy = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return pa.table({"doc_id": pa.array(every, kind).take(pa.array(row.astype(np.int64))), "start_word": pa.array(lo.astype(np.int64)), "end_word": pa.array(hi.astype(np.int64)), "copy": pa.array(copy.astype(bool))})

    return run


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (half-open, in words of the text) and copy of every maximal repeated span.

    A span with copy = false holds windows that occur here first; one with copy = true holds windows that occurred before.
    """
    kind = docs.schema["doc_id"].dataType
    integral = isinstance(kind, (ByteType, ShortType, IntegerType, LongType))
    order = F.coalesce(F.col("doc_id").cast("long") if integral else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.lit(int(_LAST)))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text", order.alias("order")).where(F.length("text") >= 2 * SPAN - 1)
    found = keyed.select("key", "text").mapInArrow(_emit_anchors, "h long, key long, n int")
    # Anchors that occur twice, by partial sums, so one that very many texts hold is counted where they are; they meet their places again
    # in a join, whose skewed keys Spark splits.
    often = found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    hot = found.select("h", "key").join(often.hint("merge"), "h").groupBy("key").agg(F.collect_list("h").alias("hot"))
    # A merge join brings rows of one key together, in order.
    sent = keyed.join(hot.hint("merge"), "key").select("key", "doc_id", "text", "order", "hot").sortWithinPartitions("key")
    arrow = to_arrow_type(kind)
    states = stored(sent.mapInArrow(_shards(arrow), _STATE.format(kind=kind.simpleString())), "shards")
    words = states.agg(F.sum(F.length("words"))).first()[0] or 0
    parts = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // (4 * PART)))
    keys = states.mapInArrow(_send(parts), "part int, shard long, keys binary, owners binary")
    bits = keys.groupBy("part").applyInArrow(_merge, "shard long, part int, shared binary, first binary")
    return states.groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(_spans(parts, arrow), f"doc_id {kind.simpleString()}, start_word long, end_word long, copy boolean")
