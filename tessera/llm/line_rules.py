"""Line-first cleaning: rules judge each line, failing lines go, then documents that lost too much text are rejected.

Everything stays in the JVM as one narrow projection: no shuffle, no Python.

Defined results: a null text counts as empty; a document without any visible text has kept_share 1.0, no text and is
kept (it lost nothing). Blank lines are dropped and count neither as kept nor as lost. Repeated rows are judged each on
its own, columns other than doc_id and text are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line of prose ends in terminal punctuation, perhaps inside quotes or brackets.
TERMINAL = r"""[.!?…。！？:;]["'”’»)\]]*\s*$"""
BOILERPLATE = (
    r"licensed under|creative commons|general public license|apache license|all rights reserved|copyright|©|cookie|privacy policy"
    r"|terms of (use|service)|javascript|subscribe to|sign up for|click here|powered by"
)
NAVIGATION = r"^\s*(home|menu|login|log in|sign in|next|previous|back to top|share this|read more)\b[^.!?]*$"
SYMBOLS = r"[^#$%&*<>{}=~^\\|]"
#: At most this share of a line may be symbols.
MAX_SYMBOLS = 0.1
#: A document must keep this share of its visible characters.
MIN_SHARE = 0.5


def line_passes(line: Column) -> Column:
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    symbols = F.length(F.regexp_replace(line, SYMBOLS, ""))
    low = F.lower(line)
    return (bars < 2) & line.rlike(TERMINAL) & (symbols <= F.length(line) * F.lit(MAX_SYMBOLS)) & ~low.rlike(BOILERPLATE) & ~low.rlike(NAVIGATION)


def clean_lines(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, text (cleaned), n_lines, n_kept, kept_share and keep for each document; see the module for edge cases."""
    visible = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)
    lined = docs.select("doc_id", visible.alias("_lines")).select("doc_id", "_lines", F.filter("_lines", line_passes).alias("_kept"))

    def chars(name: str) -> Column:
        return F.length(F.array_join(name, ""))

    share = F.when(F.size("_lines") == 0, F.lit(1.0)).otherwise(F.round(chars("_kept") / chars("_lines"), 6))
    out = lined.select("doc_id", F.array_join("_kept", "\n").alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.size("_kept").cast("long").alias("n_kept"), share.alias("kept_share"))
    return out.withColumn("keep", F.col("kept_share") >= min_share)


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE = f"""
WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x, ' ')) > 0) AS lines FROM documents),
k AS (SELECT doc_id, lines, list_filter(lines, lambda x:
    length(x) - length(replace(x, '|', '')) < 2
    AND regexp_matches(x, '{_quoted(TERMINAL)}')
    AND length(regexp_replace(x, '{_quoted(SYMBOLS)}', '', 'g')) <= length(x) * CAST({MAX_SYMBOLS} AS DOUBLE)
    AND NOT regexp_matches(lower(x), '{_quoted(BOILERPLATE)}')
    AND NOT regexp_matches(lower(x), '{_quoted(NAVIGATION)}')) AS kept FROM l),
s AS (SELECT doc_id, coalesce(array_to_string(kept, chr(10)), '') AS text, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(kept) AS BIGINT) AS n_kept,
    CASE WHEN len(lines) = 0 THEN CAST(1.0 AS DOUBLE)
    ELSE round(CAST(length(coalesce(array_to_string(kept, ''), '')) AS DOUBLE) / length(array_to_string(lines, '')), 6) END AS kept_share FROM k)
SELECT doc_id, text, n_lines, n_kept, kept_share, kept_share >= {MIN_SHARE} AS keep FROM s
"""
