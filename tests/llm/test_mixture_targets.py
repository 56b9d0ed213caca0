"""Given targets: what is drawn meets them, also where cells are full; what nobody named shares the rest."""

import numpy as np
import pandas as pd
import pytest

from tessera.llm import mixture

SCHEMA = "doc_id long, text string, lang string, source string, _row string, p string, category string"


def cells(seed, hot=1):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(50, 1000) * (hot if i == 0 else 1))) for i in range(9) for j in range(4) for k in range(3)]
    return pd.DataFrame(rows, columns=["_source", "_lang", "_topic", "tokens"])


@pytest.mark.parametrize("hot", [1, 60])
@pytest.mark.parametrize("seed", range(4))
def test_marginals_are_met_where_cells_are_full(seed, hot):
    c = cells(seed, hot)
    wanted = {"l0": 0.4, "l1": 0.3, "l2": 0.2, "l3": 0.1}
    c["share_lang"] = c["_lang"].map(wanted)
    out = mixture.rake(c, {"_source": 0.3, "_lang": "share_lang", "_topic": 0.0}, mixture.SWEEPS, 0.9)
    drawn = out["p"] * out["tokens"]
    assert (out["p"] > 1 - 1e-9).any() and out["p"].max() <= 1
    for name, target in (("_lang", pd.Series(wanted)), ("_topic", pd.Series(1 / 3, ["t0", "t1", "t2"]))):
        assert np.allclose((drawn.groupby(out[name]).sum() / drawn.sum()).loc[target.index], target, rtol=1e-3)
    observed = (c.groupby("_source")["tokens"].sum() / c["tokens"].sum()) ** 0.3
    assert np.allclose(drawn.groupby(out["_source"]).sum() / drawn.sum(), observed / observed.sum(), rtol=1e-3)


def test_sweeps_converge():
    c = cells(7, 60)
    coded = []
    for name in ("_source", "_lang", "_topic"):
        code, there = pd.factorize(c[name])
        coded.append((code, np.full(len(there), 1 / len(there))))
    tokens = c["tokens"].to_numpy()
    misses = [mixture.fit(tokens, coded, 0.02, n, True)[1] for n in (1, 2, 5, 20, 100)]
    assert all(a >= b - 1e-12 for a, b in zip(misses, misses[1:])) and misses[-1] < mixture.TOLERANCE < misses[0]


def test_categories_that_nobody_named_share_the_rest():
    found = mixture.targets_of(np.array([0.5, 0.3, 0.2]), np.array([0.4, np.nan, np.nan]))
    assert np.allclose(found, [0.4, 0.36, 0.24])
    assert np.allclose(mixture.targets_of(np.array([0.5, 0.5]), np.array([0.2, 0.6])), [0.25, 0.75])
    assert np.allclose(mixture.targets_of(np.array([0.8, 0.2]), 1.0), [0.8, 0.2])


def test_null_is_a_category_of_its_own(spark):
    rows = [(i, "one two three", lang, source, "r", "p", "c") for i, (lang, source) in enumerate([(None, "a"), ("", "a"), ("en", None), ("en", ""), ("en", "a")] * 20)] + [(None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixture.mix(docs, {"lang": mixture.shares(spark, {"en": 0.5}), "source": 1.0, "topic": 1.0}, keep=0.3).toPandas()
    assert len(found) == 101 and found["p"].notna().all()
    named = found.groupby(["source", "lang"], dropna=False)["p"].nunique()
    assert len(named) == 6 and (named == 1).all()
    en = found[found["lang"] == "en"]
    assert np.isclose((en["p"] * en["tokens"]).sum() / (found["p"] * found["tokens"]).sum(), 0.5, rtol=1e-3)
    kept = mixture.sample(docs, keep=0.9)
    assert kept.columns == docs.columns and set(kept.toPandas()["_row"].dropna()) == {"r"}


def test_repeated_rows_are_drawn_together(spark):
    rows = [(i % 30, f"text {i % 30}", "en", "a", None, None, None) for i in range(90)]
    found = mixture.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 90 and all(len({r.sampled for r in found if r.doc_id == i}) == 1 for i in range(30))
