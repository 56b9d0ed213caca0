"""Recall of the grid join by distance, with the tables of large inputs."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import simhash


@pytest.mark.parametrize("n", [10_000, 250_000, 12_000_000])
@pytest.mark.parametrize("bits", [36, 46])
def test_pairs_up_to_the_radius_meet(n, bits):
    outer, tables = simhash.shape(n)
    rng = np.random.default_rng(bits)
    pairs, met = 250, 0
    run = simhash._cells(outer, tables)
    for _ in range(pairs):
        a = rng.integers(0, 256, 32, dtype=np.uint8)
        flip = np.zeros(256, dtype=np.uint8)
        flip[rng.permutation(256)[:bits]] = 1
        fp = np.stack([a, a ^ np.packbits(flip)])
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([x.tobytes() for x in fp], pa.binary())], names=["node", "fp"])
        cells = [b.column(0).to_pylist() for b in run([batch])]
        met += any(x == y and any(len(i) for i, _ in simhash.near_pairs(fp, simhash.RADIUS, x)) for x, y in cells)
    # 0.92 at the radius, less two deviations of 250 draws; more for closer pairs
    assert met >= 0.885 * pairs
    assert simhash.chance(bits, outer, tables) >= 0.9


def test_joined_is_union_find():
    rng = np.random.default_rng(8)
    for n, m in ((1, 0), (50, 30), (400, 300), (400, 2000)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        roots = simhash._Roots(n)
        for x, y in zip(a.tolist(), b.tolist()):
            roots.join(x, y)
        found = simhash.joined(n, iter([(a[: m // 2], b[: m // 2]), (a[m // 2 :], b[m // 2 :])]))
        assert found.tolist() == [roots.find(i) for i in range(n)]
    chain = np.arange(999)
    assert (simhash.joined(1000, iter([(chain[::-1], chain[::-1] + 1)])) == 0).all()


def test_any_type_of_id(spark):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "five six seven"), ("c", None)], "doc_id string, text string")
    found = {(r.doc_id, r.keep): r.group_id for r in simhash.near_duplicates(docs).collect()}
    assert found == {("a", True): "a", ("b", False): "a", (None, True): None, ("c", True): "c"}
