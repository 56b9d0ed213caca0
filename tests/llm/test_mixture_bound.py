"""Raking under the bound: what is drawn has the marginals that are the targets."""

import numpy as np
import pandas as pd

from tessera.llm import mixture

NAMES = ("_source", "_lang", "_topic")


def test_drawn_marginals_are_the_targets():
    for seed in range(3):
        rng = np.random.default_rng(seed)
        rows = [(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(50, 1000) * (60 if i == 0 else 1))) for i in range(12) for j in range(4) for k in range(3)]
        cells = pd.DataFrame(rows, columns=[*NAMES, "tokens"])
        out = mixture.rake(cells, 0.6, 8, 0.6)
        drawn, total = out["p"] * out["tokens"], cells["tokens"].sum()
        assert (mixture.rake(cells, 0.6, 8, 0.6, bounded=False)["p"] == 1).any() and out["p"].max() <= 1
        assert 0.1 < drawn.sum() / total <= 0.6
        for name in NAMES:
            target = (cells.groupby(name)["tokens"].sum() / total) ** 0.6
            assert np.allclose(drawn.groupby(out[name]).sum() / drawn.sum(), target / target.sum(), rtol=1e-3)
