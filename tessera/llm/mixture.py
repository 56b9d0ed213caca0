"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents are counted into cells (source, language, topic) with one aggregation whose partial sums leave the map side;
the cells alone are raked (a table of sources x languages x topics, in one task, never on the driver); then each cell's
probability meets its documents again by a join on the cell. Whether a document is drawn depends only on its doc_id, its
length and the seed, so any retry or repartition draws the same documents.

Targets are given for each margin, as a DataFrame (category, share) or as an exponent x: categories then get shares in proportion to
observed share ** x (1 leaves the margin as it is, 0 makes its categories equal). Categories that a DataFrame does not name share
what it leaves over, as they are observed; shares of categories that do not occur fall away; shares are scaled to a sum of 1.

Raking multiplies the weights of every cell by factors of its source, then language, then topic, under the bound that no cell
gives more than it has: what a full cell cannot give, the others of its category do. SWEEPS over the margins fit the marginals; the
fit holds where every marginal is within TOLERANCE of its target. Expected tokens are `keep` of all tokens, or, where a category
has less than its target at that size, as much as the scarcest has; where the margins cannot be met together at that size, STEP
of it, and so on STEPS times. Where none can be met (targets against each other), the closest fit is drawn.

Defined results: null source and null language are categories of their own, apart from empty ones; a null text counts as empty; an
empty text has one token, so its document can be drawn; texts are read whole, however long; rows that agree in doc_id and text are
drawn or left together, and so are rows without doc_id that agree in length; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Topics by the first rule that a text meets: one of some substrings, or a pattern where its mark (a substring of all its matches) is there;
#: substrings are found in the text's bytes, so few texts are decoded for a pattern. The rest is prose. `topic` of mix() and sample()
#: takes another rule.
TOPICS = (
    ("legal", ("icense", "icence", "ICENSE", "opyright", "arranty", "izenz"), "", ""),
    ("code", (";\n", ") {", "){"), "=", r"""[A-Za-z0-9_] ?:?= ?["'0-9]"""),
    ("contact", (), "@", r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]"),
    ("listing", ("\n- ", "\n* ", "\n• "), "|", r"\|[^|\n]+\|"),
    ("markup", ("###", "***", "%%%", "$$$", "&&&", "</"), "", ""),
)
KEEP = 0.5
FLATTEN = 0.7
#: Sweeps over the margins, and the largest miss of a marginal as a share of its target.
SWEEPS, TOLERANCE = 100, 1e-4
STEP, STEPS = 0.85, 10
#: No category with tokens gets less than this share.
LEAST = 1e-6
SEED = "mix-1"
_MARGINS = ("_source", "_lang", "_topic")
Target = DataFrame | float
#: The targets of the driver's query: sources flattened, languages and topics by shares of their own.
LANG_SHARES = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.1}
TOPIC_SHARES = {"legal": 0.02, "code": 0.015, "contact": 0.015, "markup": 0.02}


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, parts, mark, pattern in reversed(TOPICS):
        found = F.lit(False)
        for part in parts:
            found = found | text.contains(part)
        if mark:
            found = found | (text.contains(mark) & text.rlike(pattern))
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def shares(spark: SparkSession, named: dict[str, float]) -> DataFrame:
    """A target table."""
    return spark.createDataFrame(list(named.items()), "category string, share double")


def _draw(seed: str) -> Column:
    """A number in [0, 1) made of doc_id, the text's length and the seed."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_length").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets_of(observed: np.ndarray, target: np.ndarray | float) -> np.ndarray:
    """Target share of each category from its observed share and its named share (nan: not named) or the exponent."""
    if isinstance(target, float):
        wanted = observed**target
    else:
        named = ~np.isnan(target)
        left, over = observed[~named].sum(), max(1.0 - target[named].sum(), 0.0)
        wanted = np.where(named, target, observed * (over / left if left else 0.0))
    wanted = np.maximum(wanted, LEAST)
    return wanted / wanted.sum()


def fit(tokens: np.ndarray, coded: list[tuple[np.ndarray, np.ndarray]], size: float, sweeps: int, bounded: bool) -> tuple[np.ndarray, float]:
    """Probabilities raked to the targets at `size` of all tokens, and the largest miss of a marginal as a share of its target."""
    wanted = [(code, size * tokens.sum() * target) for code, target in coded]
    weight = size * tokens
    for _ in range(sweeps):
        before = weight
        for code, want in wanted:
            full = np.zeros(len(tokens), dtype=bool)
            while True:  # the cells that reach the bound only become more
                whole = np.bincount(code, tokens * full, len(want))
                free = np.bincount(code, weight * ~full, len(want))
                factor = np.divide(want - whole, free, out=np.full(len(want), -1.0), where=free > 0)
                over = ~full & (weight * factor[code] > tokens * (1 + 1e-12))
                if not bounded or not over.any():
                    break
                full |= over
            # Where every cell is full, the factor that just fills the last one is right.
            needed = np.zeros(len(want))
            np.maximum.at(needed, code, tokens / weight)
            weight = weight * np.where(factor > 0, factor, needed)[code]
        if np.abs(weight / before - 1).max() < 1e-13:
            break
    given = np.minimum(tokens, weight)
    miss = max(np.abs(np.bincount(code, given) / want - 1).max() for code, want in wanted)
    return np.minimum(1.0, weight / tokens), float(miss)


def rake(cells: pd.DataFrame, targets: dict[str, float | str] | float, sweeps: int, keep: float, bounded: bool = True) -> pd.DataFrame:
    """Adds p, the probability of each cell, to cells with the margins and `tokens`.

    targets: by margin the exponent or the column of named shares; one exponent for all. bounded=False rakes without the bound and clips
    afterwards, for comparison: clipped cells then miss the targets.
    """
    tokens = cells["tokens"].to_numpy(dtype=np.float64)
    if not len(cells):
        return cells.assign(p=tokens)
    coded = []
    for name in _MARGINS:
        code, there = pd.factorize(cells[name], use_na_sentinel=False)
        target = targets[name] if isinstance(targets, dict) else float(targets)
        if isinstance(target, str):
            column = cells[target].to_numpy(dtype=np.float64)
            target = np.full(len(there), np.nan)
            target[code] = column
        coded.append((code, targets_of(np.bincount(code, tokens) / tokens.sum(), target)))
    size = min(keep, *((np.bincount(code, tokens) / (target * tokens.sum())).min() for code, target in coded))
    best, least = tokens, np.inf
    for k in range(STEPS):
        p, miss = fit(tokens, coded, size * STEP**k if bounded else keep, sweeps, bounded)
        if miss < least:
            best, least = p, miss
        if miss <= TOLERANCE or not bounded:
            break
    return cells.assign(p=best)


def measured(docs: DataFrame, topic: Column | None = None, *columns: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    tokens = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    return docs.select(*columns, "doc_id", F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang"), (topic_of(text) if topic is None else topic).cast("string").alias("_topic"), tokens.cast("long").alias("_tokens"), F.length(text).cast("long").alias("_length"))


def cell_probabilities(counted: DataFrame, keep: float, targets: dict[str, Target]) -> DataFrame:
    """_source, _lang, _topic and p of every cell."""
    cells = counted.groupBy(*_MARGINS).agg(F.sum("_tokens").alias("tokens"))
    plain: dict[str, float | str] = {}
    for name in _MARGINS:
        target = targets.get(name[1:], FLATTEN)
        if isinstance(target, DataFrame):
            plain[name] = f"share{name}"
            known = target.groupBy(F.col("category").cast("string").alias("category")).agg(F.sum("share").cast("double").alias(plain[name]))
            cells = cells.join(known, F.col(name).eqNullSafe(F.col("category")), "left").drop("category")
        else:
            plain[name] = float(target)
    schema = "_source string, _lang string, _topic string, p double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return rake(pdf.sort_values(list(_MARGINS), ignore_index=True), plain, SWEEPS, keep)[[*_MARGINS, "p"]]

    # Written out, the table's size is known when the join is planned: a small one travels to the documents, a large one is merged.
    return stored(cells.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, schema), "cells")


def _meet(counted: DataFrame, cells: DataFrame) -> DataFrame:
    held = cells.select(*(F.col(c).alias(f"{c}_of") for c in _MARGINS), "p")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in _MARGINS]
    return counted.join(held, same[0] & same[1] & same[2])


def mix(docs: DataFrame, targets: dict[str, Target] | None = None, keep: float = KEEP, topic: Column | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, source, lang, topic, tokens, p (6 places) and sampled for each document; see the module for edge cases.

    targets: by margin (source, lang, topic) a DataFrame (category, share) or an exponent; FLATTEN where a margin is not named.
    """
    # Texts are read once and never take part in the join: it carries the few numbers that were measured on them.
    counted = stored(measured(docs, topic), "measured")
    joined = _meet(counted, cell_probabilities(counted, keep, targets or {}))
    return joined.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("p", 6).alias("p"), (_draw(seed) < F.col("p")).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, Target] | None = None, keep: float = KEEP, topic: Column | None = None, seed: str = SEED) -> DataFrame:
    """The sampled documents themselves, with their own columns; parameters as of mix()."""
    cells = cell_probabilities(measured(docs, topic), keep, targets or {})
    whole = measured(docs, topic, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return _meet(whole, cells).where(_draw(seed) < F.col("p")).select("_row.*")


def production_targets(spark: SparkSession) -> dict[str, Target]:
    return {"source": FLATTEN, "lang": shares(spark, LANG_SHARES), "topic": shares(spark, TOPIC_SHARES)}


def _oracle() -> str:
    """The same fit: all sizes are raked side by side, one factor (the largest that overfills no cell before it) at a step."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def rule(parts: tuple[str, ...], mark: str, pattern: str) -> str:
        return " OR ".join([*(f"contains(t, {quoted(p)})" for p in parts), *([f"contains(t, {quoted(mark)}) AND regexp_matches(t, {quoted(pattern)})"] if mark else [])])

    cases = " ".join(f"WHEN {rule(*rest)} THEN '{name}'" for name, *rest in TOPICS)

    def values(named: dict[str, float]) -> str:
        return ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in named.items())

    ctes = [
        "m AS (SELECT doc_id, source, lang, CASE " + cases + " ELSE 'prose' END AS topic, CAST(length(t) - length(replace(t, ' ', '')) + 1 AS BIGINT) AS tokens, length(t) AS n FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents))",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM m GROUP BY ALL)",
        "al AS (SELECT sum(tokens) AS total FROM c)",
        f"w_source AS (SELECT source AS category, sum(tokens) / any_value(total) AS o, greatest(pow(sum(tokens) / any_value(total), {FLATTEN}), {LEAST}) AS x FROM c, al GROUP BY source)",
    ]
    for name, named in (("lang", LANG_SHARES), ("topic", TOPIC_SHARES)):
        ctes.append(f"n_{name} AS (SELECT {name} AS category, sum(tokens) / any_value(total) AS o, any_value(share) AS share FROM c LEFT JOIN (VALUES {values(named)}) AS g(category, share) ON g.category = {name}, al GROUP BY {name})")
        ctes.append(f"w_{name} AS (SELECT category, o, greatest(coalesce(share, o * greatest(1 - coalesce(sum(share) OVER (), 0), 0) / sum(o) FILTER (share IS NULL) OVER ()), {LEAST}) AS x FROM n_{name})")
    for name in ("source", "lang", "topic"):
        ctes.append(f"t_{name} AS (SELECT category, o, x / sum(x) OVER () AS target FROM w_{name})")
    ctes += [
        f"high AS (SELECT least({KEEP}, " + ", ".join(f"(SELECT min(o / target) FROM t_{x})" for x in ("source", "lang", "topic")) + ") AS high)",
        f"start AS (SELECT k, high * pow(CAST({STEP} AS DOUBLE), k) AS size FROM high, range({STEPS}) AS r(k))",
        """it AS (SELECT CAST(0 AS INTEGER) AS step, k, source, lang, topic, tokens, size * tokens AS w, a.target * size * total AS want_s, b.target * size * total AS want_l, d.target * size * total AS want_t
  FROM c, start, al, t_source a, t_lang b, t_topic d WHERE a.category IS NOT DISTINCT FROM source AND b.category IS NOT DISTINCT FROM lang AND d.category IS NOT DISTINCT FROM topic
UNION ALL SELECT step + 1, k, source, lang, topic, tokens, w * coalesce(max(f) FILTER (f > 0 AND f <= r * (1 + 1e-12)) OVER (PARTITION BY k, cat), max(r) OVER (PARTITION BY k, cat)), want_s, want_l, want_t
  FROM (SELECT *, tokens / w AS r, (CASE step % 3 WHEN 0 THEN want_s WHEN 1 THEN want_l ELSE want_t END - coalesce(sum(tokens) OVER (PARTITION BY k, cat ORDER BY tokens / w, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (PARTITION BY k, cat ORDER BY tokens / w, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f
    FROM (SELECT *, CASE step % 3 WHEN 0 THEN concat('s', coalesce(source, chr(1))) WHEN 1 THEN concat('l', coalesce(lang, chr(1))) ELSE concat('t', coalesce(topic, chr(1))) END AS cat FROM it))
  WHERE step < """
        + str(3 * SWEEPS)
        + ")",
        f"done AS (SELECT *, least(tokens, w) AS given FROM it WHERE step = {3 * SWEEPS})",
        "miss AS (SELECT k, max(d) AS miss FROM ("
        + " UNION ALL ".join(f"SELECT k, abs(sum(given) / any_value(want_{x[0]}) - 1) AS d FROM done GROUP BY k, {x}" for x in ("source", "lang", "topic"))
        + ") GROUP BY k)",
        f"chosen AS (SELECT k FROM miss ORDER BY CASE WHEN miss <= {TOLERANCE} THEN 0 ELSE 1 END, CASE WHEN miss <= {TOLERANCE} THEN k ELSE miss END, k LIMIT 1)",
        "p AS (SELECT source, lang, topic, least(1.0, w / tokens) AS p FROM done JOIN chosen USING (k))",
    ]
    return (
        "WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT doc_id, m.source, m.lang, m.topic, m.tokens, round(CAST(p AS DOUBLE), 6) AS p, "
        f"CAST(concat('0x', substr(md5(concat('{SEED}|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', n)), 1, 8)) AS BIGINT) / 4294967296.0 < p AS sampled FROM m JOIN p"
        " ON m.source IS NOT DISTINCT FROM p.source AND m.lang IS NOT DISTINCT FROM p.lang AND m.topic = p.topic"
    )


ORACLE = _oracle()
