"""Near-duplicates by SimHash: segment popcounts as an embedding, a grid join on them, exact verification, groups.

1. A document's fingerprint is the SimHash of its distinct words: 256 bits, bit j set when more of its words have bit j
   of their hash set than not.
2. A fingerprint is embedded as the bit counts of its 128 segments of two bits. The Manhattan distance of two embeddings
   never exceeds the Hamming distance of the fingerprints, so it bounds it from below.
3. Grid join: `tables` times, every fingerprint goes to the grid cell that its counts in a few segments name; in a cell
   (one task's data) pairs that agree in one of several further sets of segments are candidates, those whose Manhattan
   distance exceeds `radius` go, and the rest are verified by their exact Hamming distance.
4. Pairs within `radius` link documents; groups are the connected components, and the smallest doc_id stays.

Two words in twenty changed leave about 36 of 256 bits different, unrelated documents about 100. The number of segments
that name a cell follows from the number of fingerprints (cells stay near CELL of them), and the number of tables
from that, so that a pair at the radius itself meets in some cell, and is a candidate there, with a probability of RECALL or
more whatever the size of the data. Equal fingerprints are collapsed before the join, and inside a cell a dense set is linked through pivots with
the triangle inequality instead of pair by pair, so large groups of copies cost no quadratic work.

Defined results: a null or wordless text has no fingerprint; such a document is a group of its own and is kept. A null
doc_id is allowed: it sorts after every other, so such a row is kept only where no row of its group has a doc_id. Of
rows that agree in doc_id and text one stays. doc_id may be of any type that has an order. Texts are read whole, however long. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, scan, stored, within
from .components import components

BITS = 256
RADIUS = 46
#: Fingerprints that a grid cell is meant to hold, and segments and sets of them for candidates inside a cell.
CELL = 20_000
INNER, SETS = 8, 32
#: Chance that a pair at the radius becomes a candidate, and that one segment's counts agree for unrelated documents.
RECALL, FAR = 0.92, 0.42
_WIDE = np.array([int.from_bytes(bytes((i >> (7 - j)) & 1 for j in range(8)), "little") for i in range(256)], dtype=np.uint64)
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 32) bytes of SimHash over the distinct words of each text; texts without words get zeros."""
    n = len(first) - 1
    out = np.zeros((n, BITS // 8), dtype=np.uint8)
    if not len(h):
        return out
    # One sort of (text, 40 bits of the hash): equal words of a text fall together. A piece has far fewer than 2**24 texts.
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    key = np.sort((doc << np.uint64(40)) | (h >> np.uint64(24)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    doc = (key >> np.uint64(40)).astype(np.int64)
    word = key & np.uint64((1 << 40) - 1)
    sums = np.zeros((n, BITS), dtype=np.int32)
    for lo in range(0, len(key), 1 << 15):
        # Sums of up to 255 bits fit the byte lanes of a uint64, so runs end at 255 words and at the end of a text.
        part, where = mix(word[lo : lo + (1 << 15)]), doc[lo : lo + (1 << 15)]
        starts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        runs = -(-np.diff(np.append(starts, len(where))) // 255)
        cuts = np.repeat(starts, runs) + 255 * within(runs)
        raw = np.stack([mix(part ^ s) for s in _SALTS], axis=1).view(np.uint8)
        lanes = np.add.reduceat(_WIDE[raw], cuts, axis=0).view(np.uint8)
        same = np.cumsum(runs) - runs
        sums[where[starts]] += np.add.reduceat(lanes.astype(np.int32), same, axis=0)
    counts = np.bincount(doc, minlength=n)
    return np.packbits(sums * 2 > counts[:, None], axis=1)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(2)
        for lo, hi, words in scan(texts):
            fp = fingerprints(words.hash, words.first)
            counts = np.diff(words.first)
            flat = pa.py_buffer(np.ascontiguousarray(fp))
            binary = pa.Array.from_buffers(pa.binary(BITS // 8), hi - lo, [None, flat]).cast(pa.binary())
            mask = pa.array(counts > 0)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pc.if_else(mask, binary, pa.scalar(None, pa.binary()))], names=["doc_id", "row_key", "fp"])


def chance(bits: int, outer: int, tables: int) -> float:
    """Exact chance that two fingerprints that differ in `bits` random bits become candidates in one of the tables."""
    n, total = BITS // 2, 0.0
    for both in range(max(0, bits - n), bits // 2 + 1):
        ways = math.comb(n, both) * math.comb(n - both, bits - 2 * both) * 2 ** (bits - 2 * both) / math.comb(BITS, bits)
        for opposite in range(both + 1):  # of segments of which both bits differ, those with equal counts
            same = n - bits + both + opposite
            cell = math.comb(same, outer) / math.comb(n, outer)
            inner = 1 - (1 - math.comb(same, INNER) / math.comb(n, INNER)) ** SETS
            total += ways * math.comb(both, opposite) / 2**both * (1 - (1 - cell * inner) ** tables)
    return total


def shape(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """Segments that name a cell, and tables, for n fingerprints."""
    outer = max(2, math.ceil(math.log(max(n, 2) / CELL) / -math.log(FAR))) if n > CELL else 2
    tables = 4
    while chance(radius, outer, tables) < RECALL:
        tables += 1
    return outer, tables


def segments(fp: np.ndarray) -> np.ndarray:
    """(n, 128) bit counts of the two-bit segments of (n, 32) bytes."""
    bits = np.unpackbits(fp, axis=1)
    return bits[:, ::2] + bits[:, 1::2]


def _cells(outer: int, tables: int):
    picks = [np.random.default_rng(1000 + t).permutation(BITS // 2)[:outer] for t in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(n, -1)
            counts = segments(fp).astype(np.int64)
            for t, pick in enumerate(picks):
                cell = np.zeros(n, dtype=np.int64)
                for j in pick:
                    cell = cell * 3 + counts[:, j]
                yield pa.RecordBatch.from_arrays([pa.array(cell * tables + t), batch.column(0), batch.column(1)], names=["cell", "node", "fp"])

    return run


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of the two-bit segments' counts: a segment of which both bits differ counts 0 where it is 01 against 10."""
    d = a ^ b
    opposite = d & (d >> _ONE) & (a ^ (a >> _ONE)) & _LOW
    return np.bitwise_count(d).sum(axis=-1, dtype=np.int16) - 2 * np.bitwise_count(opposite).sum(axis=-1, dtype=np.int16)


class _Roots:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each row's component; pairs are taken in whole arrays, of which those that link nothing new go at once."""
    root = np.arange(n)
    for a, b in pairs:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            continue
        a, b = a[apart], b[apart]
        while True:
            low = np.minimum(a, b)
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while not np.array_equal(root, up := root[root]):
                root = up
            a, b = root[a], root[b]
            if np.array_equal(root, before) or (a == b).all():
                break
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def _pivoted(members: np.ndarray, words: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within radius that connect the members just as all such pairs would: every pivot takes the rows near it out.

    A row that was taken can only be near a row within twice the radius of its pivot, so only those are compared with it.
    """
    left = members
    while len(left) > 1:
        d = _hamming(words[left], words[left[0]])
        near = d <= radius
        taken, rest = left[near], left[~near]
        yield np.full(len(taken) - 1, left[0]), taken[1:]
        edge = rest[d[~near] <= 2 * radius]
        for x in edge if len(edge) <= len(taken) else ():
            hit = taken[_hamming(words[taken], words[x]) <= radius]
            yield np.full(len(hit), x), hit
        if len(edge) > len(taken):
            for x in taken[1:]:
                hit = edge[_hamming(words[edge], words[x]) <= radius]
                yield np.full(len(hit), x), hit
        left = rest


def near_pairs(fp: np.ndarray, radius: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of (n, 32) bytes within radius whose counts agree in one of SETS sets of segments."""
    words = np.ascontiguousarray(fp).view(np.uint64)
    counts = segments(fp)
    rng = np.random.default_rng(seed)
    for _ in range(SETS):
        key = np.zeros(len(fp), dtype=np.int64)
        for j in rng.permutation(BITS // 2)[:INNER]:
            key = key * 3 + counts[:, j]
        order = np.argsort(key, kind="stable")
        key = key[order]
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        # Rows of a dense bucket reach far fewer others through pivots than pair by pair.
        for lo, hi in zip(starts[sizes > 256], ends[sizes > 256]):
            yield from _pivoted(order[lo:hi], words, radius)
        last = np.repeat(np.where(sizes > 256, starts, ends), sizes)
        at = np.arange(len(key))
        step = 1
        while True:
            at = at[at + step < last[at]]
            if not len(at):
                break
            a, b = order[at], order[at + step]
            x, y = words[a], words[b]
            ok = _manhattan(x, y) <= radius
            a, b = a[ok], b[ok]
            ok = _hamming(x[ok], y[ok]) <= radius
            yield a[ok], b[ok]
            step += 1


def _link(radius: int):
    def run(table: pa.Table) -> pa.Table:
        n = len(table)
        node = table.column("node").to_numpy()
        fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), dtype=np.uint8).reshape(n, -1)
        root = joined(n, near_pairs(fp, radius, int(table.column("cell")[0].as_py())))
        linked = root != np.arange(n)
        return pa.table({"a": node[linked], "b": node[root[linked]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def link(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b that connect the nodes of prints (node, fp: distinct) that are within radius of each other."""
    outer, tables = shape(prints.count(), radius)
    cells = prints.select("node", "fp").mapInArrow(_cells(outer, tables), "cell long, node long, fp binary")
    return cells.groupBy("cell").applyInArrow(_link(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, row_key (hash of doc_id and text), group_id (smallest doc_id of the group), group_size and keep (one row in each group)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(_fingerprint, f"doc_id {kind}, row_key long, fp binary")
    rows = stored(rows, "fingerprints").withColumn("node", F.xxhash64("fp"))
    prints = stored(rows.where("fp IS NOT NULL").groupBy("fp").agg(F.first("node").alias("node")), "prints")
    groups = components(link(prints, radius), "groups")
    alone = F.when(F.col("fp").isNull(), F.col("row_key").cast("string"))
    rooted = rows.join(groups, "node", "left").withColumn("_group", F.coalesce("root", "node").cast("string"))
    rooted = rooted.withColumn("_group", F.coalesce(F.concat(F.lit("-"), alone), "_group"))
    group = Window.partitionBy("_group")
    first = group.orderBy(F.col("doc_id").asc_nulls_last(), "row_key")
    return rooted.select("doc_id", "row_key", F.min("doc_id").over(group).alias("group_id"), F.count("*").over(group).alias("group_size"), (F.row_number().over(first) == 1).alias("keep"))
