"""The suffix array decides what repeats in a shard: a wrong order gives a wrong answer, and keys that collide give none."""

import numpy as np
import pyarrow as pa

from tessera.llm import suffixes


def shard(rng):
    v = rng.integers(0, 2**32, 5000, dtype=np.uint32)
    passage = rng.choice(v, 70)
    regions = [rng.choice(v, 60), np.concatenate([rng.choice(v, 20), passage, rng.choice(v, 15)]), passage, rng.choice(v, 40)]
    length = np.array([len(r) for r in regions])
    return suffixes._state(0, [5, 3, 9, 1], [5, 3, 9, 1], np.arange(4), np.zeros(4, dtype=int), length, np.concatenate(regions), pa.int64()).to_pylist()[0]


def marked(state):
    w = suffixes._Windows(state)
    return {(int(r), int(a)) for r, a, x in zip(w.row, w.at, w.local) if x}, len(w.keys)


def test_a_wrong_order_fails(monkeypatch):
    expected = {(1, 20 + i) for i in range(21)} | {(2, i) for i in range(21)}
    assert marked(shard(np.random.default_rng(1))) == (expected, 11 + 56 + 21 - 21)
    right = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda t: np.random.default_rng(2).permutation(right(t)))
    assert marked(shard(np.random.default_rng(1)))[0] != expected


def test_colliding_keys_make_no_repeat_in_a_shard(monkeypatch):
    state = shard(np.random.default_rng(1))
    expected = marked(state)
    monkeypatch.setattr(suffixes, "grams", lambda words, size: np.zeros(max(0, len(words) - size + 1), dtype=np.uint64))
    assert marked(state) == expected
    w = suffixes._Windows(state)
    alone = pa.table({"shard": [0], "part": pa.array([0], pa.int32()), "keys": [w.keys.tobytes()], "owners": [w.owner.tobytes()]})
    assert not np.unpackbits(np.frombuffer(suffixes._merge(alone).column("shared")[0].as_py(), dtype=np.uint8)).any()


def test_any_type_of_id(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words, 60))
    rows = [("b", passage), ("a", "x " + passage), (None, passage + " y"), ("c", " ".join(rng.choice(words, 200)))]
    found = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.start_word, r.end_word) for r in found) == [("", 0, 60), ("a", 1, 61), ("b", 0, 60)]
    assert sorted(r.copy for r in found) == [False, True, True] and all(r.copy for r in found if r.doc_id is None)
