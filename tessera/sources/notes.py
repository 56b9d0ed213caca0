"""Markdown notes: frontmatter, aliases, tags, links, headings and their chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udf
from ..operators.chunk import chunk_markdown, with_context

NOTE = "struct<frontmatter:map<string,array<string>>,body:string,headings:array<string>,links:array<string>,tags:array<string>,aliases:array<string>>"


def _distinct(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def frontmatter(s: str) -> tuple[dict[str, list[str]], str]:
    """Keys with their values (one for a scalar, several for a list in brackets or in lines) and the text after the block."""
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", s, re.DOTALL)
    if not m:
        return {}, s
    out: dict[str, list[str]] = {}
    key = None
    for line in m.group(1).split("\n"):
        item = re.match(r"\s*-\s+(.*)$", line)
        pair = re.match(r"([\w\-]+)\s*:\s*(.*)$", line)
        if item and key:
            out[key].append(_plain(item.group(1)))
        elif pair:
            key, value = pair.group(1), pair.group(2).strip()
            if value.startswith("[") and value.endswith("]"):
                out[key] = [_plain(x) for x in value[1:-1].split(",") if x.strip()]
            else:
                out[key] = [_plain(value)] if value else []
    return out, s[m.end() :]


def _plain(value: str) -> str:
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1]
    return value.lower() if value.lower() in ("true", "false") else value


def _listed(values: list[str]) -> list[str]:
    return [x.strip() for v in values for x in v.split(",") if x.strip()]


def parse_note(s: str) -> dict:
    front, body = frontmatter(s)
    links = [re.split(r"[|#]", x)[0].strip() for x in re.findall(r"(?<!!)\[{2}([^\]]+)\]{2}", body)]
    tags = [x.lstrip("#") for x in _listed(front.get("tags", []) + front.get("tag", []))]
    return {
        "frontmatter": front,
        "body": body,
        "headings": [h.strip() for h in re.findall(r"^#{1,6}[ \t]+(.+)$", body, re.MULTILINE)],
        "links": _distinct(links),
        "tags": _distinct(tags + re.findall(r"(?<![/\w])#(\w[-\w/]*)", body)),
        "aliases": _distinct(_listed(front.get("aliases", []) + front.get("alias", []))),
    }


@udf.pandas(NOTE)
def note_column(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_note(s or "") for s in texts], columns=["frontmatter", "body", "headings", "links", "tags", "aliases"])


def embedding_text(title: Column, note: Column) -> Column:
    """Title, names, tags, up to 20 links and headings, and the body, each part on lines of its own; parts without content are left out."""

    def part(label: str, values: Column, mark: str = ", ") -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, mark)))

    name = F.when(F.length(T.strip(T.text(title))) > 0, F.concat(F.lit("Title: "), T.strip(title)))
    tags = F.transform(note["tags"], lambda t: F.concat(F.lit("#"), t))
    body = F.when(F.length(T.text(note["body"])) > 0, note["body"])
    return T.strip(F.concat_ws("\n", name, part("Aliases", note["aliases"]), part("Tags", tags), part("Links", F.slice(note["links"], 1, 20)), part("Headings", F.slice(note["headings"], 1, 20), " | "), body))


def inner_links(text: str) -> list[str]:
    return _distinct([re.split(r"[|#]", x)[0].strip() for x in re.findall(r"(?<!!)\[{2}([^\]]+)\]{2}", text)])


def inner_tags(text: str) -> list[str]:
    return _distinct(re.findall(r"(?<![/\w])#(\w[-\w/]*)", text))


_CUT = "headings array<string>, start int, end int, text string, tags array<string>, links array<string>, note_tags array<string>, aliases array<string>"


def note_chunks(df: DataFrame, key: str, content: str, most: int = 256, least: int = 32, size: int = 1200, overlap: int = 160, window: int = 1) -> DataFrame:
    """key, idx, headings, span, text, indexed, context, tags, links and aliases of each chunk of a note; long chunks are cut into windows.

    indexed is text with the chunk's headings, and its own tags and links (10 at most), each on a line, before it; context is what `window` neighbours on
    either side hold; tags are those of the note, then those of the chunk.
    """

    def cut(s: str) -> list[dict]:
        note, rows = parse_note(s), []
        for heads, c in chunk_markdown(note["body"], most, least):
            spans = [(0, len(c))]
            if len(c) > size:
                stride = size - overlap
                spans = [(a, min(len(c), a + size)) for a in range(0, max(1, len(c) - overlap), stride)]
            rows += [{"headings": heads, "start": a, "end": b, "text": c[a:b], "tags": inner_tags(c[a:b]), "links": inner_links(c[a:b]), "note_tags": note["tags"], "aliases": note["aliases"]} for a, b in spans]
        return rows

    rows = udf.exploded(df, key, content, _CUT, cut)
    rows = with_context(rows, key, "idx", F.concat_ws("\n", T.context_label(F.col("headings")), "text"), window)

    def part(label: str, values: Column, mark: str) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, mark)))

    hashed = F.transform("tags", lambda t: F.concat(F.lit("#"), t))
    text = F.concat_ws("\n", part("Headings", F.col("headings"), " > "), part("Tags", hashed, ", "), part("Links", F.slice("links", 1, 10), ", "), "text")
    return rows.select(key, "idx", "headings", "start", "end", "text", text.alias("indexed"), "context", F.array_distinct(F.concat("note_tags", "tags")).alias("tags"), "links", "aliases")
