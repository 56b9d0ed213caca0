"""Chunks of documents: character windows, Markdown sections, context from neighbours."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udf


def windows(df: DataFrame, key: str, content: str, size: int = 800, overlap: int = 120, *carried: str) -> DataFrame:
    """key, idx (from 0), start, end, text and the carried columns: windows of `size` characters that overlap; the last ends with the text."""
    n, stride = F.length(content), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(stride))
    rows = df.where(F.length(content) > 0).select(key, content, *carried, F.posexplode(starts).alias("idx", "start"))
    end = F.least(n, F.col("start") + size)
    return rows.select(key, F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("start"), end.cast("long").alias("end"), F.substring(F.col(content), F.col("start") + 1, F.lit(size)).alias("text"), *carried)


def atoms(df: DataFrame, key: str, uri: str, content: str, size: int = 800, overlap: int = 120, least: int = 80) -> DataFrame:
    """The windows of at least `least` characters of text, with URIs numbered from 1 before the short ones go."""
    out = windows(df.withColumn("_uri", F.col(uri)), key, content, size, overlap, "_uri")
    return out.where(F.length(T.strip(F.col("text"))) >= least).select(key, "idx", "start", "end", "text", T.chunk_uri(F.col("_uri"), F.col("idx") + 1).alias("uri"))


def resplit(df: DataFrame, key: str, content: str, size: int = 1200, overlap: int = 160) -> DataFrame:
    """Chunks of over `size` characters as windows; others whole."""
    return windows(df, key, content, size, overlap)


def _tokens(s: str) -> int:
    return int(len(s.split()) / 0.75)


def split_sentences(s: str) -> list[str]:
    return [x for x in re.split(r"(?<=[!.?])\s+", s.strip()) if x]


def _pack(pieces: list[str], most: int, glue: str) -> list[str]:
    out, held, size = [], [], 0
    for p in pieces:
        n = _tokens(p)
        if held and size + n > most:
            out.append(glue.join(held))
            held, size = [], 0
        held.append(p)
        size += n
    return [*out, glue.join(held)] if held else out


def sections(s: str) -> list[tuple[list[str], str]]:
    """Headings above and body of every part between headings; a heading of level n drops those at depth n and below."""
    marks = list(re.finditer(r"^(#{1,6})[ \t]+(\S.*)$", s, re.MULTILINE))
    out = []
    if not marks or marks[0].start():
        lead = s[: marks[0].start() if marks else len(s)].strip()
        if lead:
            out.append(([], lead))
    stack: list[str] = []
    for m, end in zip(marks, [m.start() for m in marks[1:]] + [len(s)]):
        stack = [*stack[: len(m.group(1)) - 1], m.group(2).strip()]
        body = s[m.end() : end].strip()
        if body:
            out.append((list(stack), body))
    return out


def chunk_markdown(s: str, most: int = 512, least: int = 64) -> list[tuple[list[str], str]]:
    """Chunks of at most about `most` tokens with their headings: paragraphs packed in order, long ones by sentences; small chunks join the one before."""
    chunks: list[tuple[list[str], str]] = []
    for heads, body in sections(s):
        held: list[str] = []
        for p in [body] if _tokens(body) <= most else [x.strip() for x in re.split(r"\n\s*\n", body)]:
            if p and _tokens(p) > most:
                chunks += [(heads, c) for c in (*_pack(held, most, "\n\n"), *_pack(split_sentences(p), most, " "))]
                held = []
            elif p:
                held.append(p)
        chunks += [(heads, c) for c in _pack(held, most, "\n\n")]
    out: list[tuple[list[str], str]] = []
    for heads, c in chunks:
        if out and _tokens(c) < least and _tokens(out[-1][1]) + _tokens(c) <= most:
            out[-1] = (out[-1][0], out[-1][1] + "\n\n" + c)
        else:
            out.append((heads, c))
    return out


_CHUNK = "headings array<string>, text string"


def markdown(df: DataFrame, key: str, content: str, most: int = 512, least: int = 64) -> DataFrame:
    return udf.exploded(df, key, content, _CHUNK, lambda s: [{"headings": h, "text": c} for h, c in chunk_markdown(s, most, least)])


def heading_sections(df: DataFrame, key: str, content: str) -> DataFrame:
    return udf.exploded(df, key, content, _CHUNK, lambda s: [{"headings": h, "text": c} for h, c in sections(s)])


def sentences(df: DataFrame, key: str, content: str) -> DataFrame:
    return udf.exploded(df, key, content, "sentence string", lambda s: [{"sentence": x} for x in split_sentences(s)])


def with_context(chunks: DataFrame, key: str, order: str, content: Column, reach: int = 1, most: int = 2000) -> DataFrame:
    """Adds context: the texts of up to `reach` neighbours on either side, blank lines between, cut at `most` characters."""
    w = Window.partitionBy(key).orderBy(order)
    around = [F.lag(content, i).over(w) for i in range(reach, 0, -1)] + [F.lead(content, i).over(w) for i in range(1, reach + 1)]
    return chunks.withColumn("context", F.substring(F.concat_ws("\n\n", *around), 1, most))
