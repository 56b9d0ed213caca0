"""Text of files by extension: a registry of parsers, run on binary columns in Arrow batches.

A parser takes the bytes of a file and returns text; whatever it cannot read gives an empty text. Formats that need a library which
is not there fall back to the next way, in the end to empty text.
"""

from __future__ import annotations

import csv
import io
import re
import subprocess
import tempfile
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udf

Parser = Callable[[bytes], str]
_PARSERS: dict[str, Parser] = {}


def register(*names: str) -> Callable[[Parser], Parser]:
    """Makes a parser the one for these extensions; the last one wins."""

    def add(parser: Parser) -> Parser:
        _PARSERS.update({n.lower().lstrip("."): parser for n in names})
        return parser

    return add


def supported() -> list[str]:
    return sorted(_PARSERS)


@register("md", "txt", "text", "qmd", "rmd")
def plain(data: bytes) -> str:
    return data.decode("utf-8", errors="ignore")


class _Html(HTMLParser):
    HIDDEN = set("head noscript script style template".split())
    BLOCK = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

    def __init__(self):
        super().__init__()
        self.parts = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN
        if tag in self.BLOCK and not self.depth:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.depth = max(0, self.depth - 1)
        elif tag in self.BLOCK and not self.depth:
            self.parts.append("\n")

    def handle_data(self, data):
        self.parts += [] if self.depth else [data]


def html_text(source: str) -> str:
    reader = _Html()
    reader.feed(source or "")
    reader.close()
    return re.sub(r"\n\n\n+", "\n\n", "".join(reader.parts)).strip()


@register("html", "htm", "xhtml")
def html(data: bytes) -> str:
    return html_text(plain(data))


#: A cue's times need hours, minutes, seconds and thousandths on both sides.
_VTT_TIMES = re.compile(r"(?:\d\d:){2}\d\d\.\d{3}\s+-->\s+(?:\d\d:){2}\d\d\.\d{3}")


def vtt_text(source: str) -> str:
    """The spoken lines: without header, notes, styles, regions, cue names, times and tags. A line counts from a cue's times to the next blank
    line; a line that begins like a note, a style or a region ends the cue and hides what follows up to a blank line."""
    out, state = [], ""
    for line in re.split(r"\r\n|\r|\n", source or ""):
        line = line.strip()
        if not line:
            state = ""
        elif line.startswith(("NOTE", "STYLE", "REGION")):
            state = "hidden"
        elif line.startswith("WEBVTT") or state == "hidden":
            pass
        elif _VTT_TIMES.match(line):
            state = "cue"
        elif state == "cue":
            out.append(re.sub(r"<[^>]+>", "", line))
    return "\n".join(x for x in out if x)


@register("vtt")
def vtt(data: bytes) -> str:
    return vtt_text(plain(data))


_TEX_SKIP = "equation align gather eqnarray displaymath math tikzpicture figure table tabular array".split()
_TEX_HEADS = "part chapter section subsection subsubsection".split()
_TEX_INLINE = [*(f"text{x}" for x in "bf it tt rm sc sf up md normal font".split()), *"emph mbox hbox vbox".split()]
_TEX_MARKS = "item label ref cite footnote caption".split()
#: What is written in braces once, without braces inside.
_ARG = r"\{([^}]+)\}"


def _any(names: list[str]) -> str:
    return rf"\\(?:{'|'.join(names)})"


#: In order: comments; mathematics and figures; headings on lines of their own; inline text; items and references, which leave their
#: argument; other commands with their arguments; marks that are left; white space.
_TEX_RULES = [
    (r"%[^\n]*", ""),
    *((rf"(?s)\\begin\{{{env}\*?\}}.*?\\end\{{{env}\*?\}}", " ") for env in _TEX_SKIP),
    (_any(_TEX_HEADS) + r"\*?" + _ARG, r"\n\n\1\n"),
    (_any(["title", "author", "abstract"]) + _ARG, r"\n\1\n"),
    (_any(_TEX_INLINE) + _ARG, r"\1"),
    (_any(_TEX_MARKS) + r"(?:\[[^\]]*\])?" + _ARG, r" \1 "),
    (_any(_TEX_MARKS) + r"(?:\[[^\]]*\])?(?:\{\})?", " "),
    (r"\\[a-zA-Z]+(?:\[[^\]]*\])*(?:\{[^}]*\})*", " "),
    (r"\\[^\n]", " "),
    (r"[${}&~_^]", " "),
    (r"[\t ]+", " "),
    (r"\n\n\n+", "\n\n"),
]


def latex_text(source: str) -> str:
    for pattern, to in _TEX_RULES:
        source = re.sub(pattern, to, source)
    return source.strip()


@register("tex", "latex")
def latex(data: bytes) -> str:
    return latex_text(plain(data))


def latex_column(c: Column) -> Column:
    """latex_text as a chain of expressions that stays in the JVM."""
    for pattern, to in _TEX_RULES:
        c = F.regexp_replace(c, pattern, to.replace(r"\1", "$1").replace(r"\n", "\n"))
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def csv_text(source: str) -> str:
    """Rows of cells with tabs between; the separator is found out from the first 8 KB."""
    try:
        dialect = csv.Sniffer().sniff(source[:8192], delimiters=",;\t|:")
    except csv.Error:
        dialect = csv.excel
    rows = ([cell.strip() for cell in row] for row in csv.reader(io.StringIO(source), dialect))
    return "\n".join("\t".join(r) for r in rows if any(r))


@register("csv", "tsv")
def csv_file(data: bytes) -> str:
    return csv_text(plain(data))


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _paragraph(p: ElementTree.Element) -> str:
    return "".join(("\t" if _local(t) == "tab" else t.text or "") for t in p.iter() if _local(t) in ("t", "tab"))


def _table_rows(e: ElementTree.Element) -> list[str]:
    rows = []
    for tr in (x for x in e.iter() if _local(x) == "tr"):
        cells = [" ".join(filter(None, (_paragraph(p).strip() for p in tc.iter() if _local(p) == "p"))) for tc in tr if _local(tc) == "tc"]
        if any(cells):
            rows.append("\t".join(cells))
    return rows


@register("docx", "dotx", "docm", "dotm")
def docx(data: bytes) -> str:
    """Paragraphs, then the rows of tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(x for x in _xml(z, "word/document.xml") if _local(x) == "body")
    paragraphs = [t for p in body if _local(p) == "p" and (t := _paragraph(p)).strip()]
    return "\n".join(paragraphs + [r for t in body if _local(t) == "tbl" for r in _table_rows(t)])


@register("xlsx", "xlsm", "xls")
def xlsx(data: bytes) -> str:
    """Each sheet's name and its rows, cells with tabs between."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_paragraph(si) for si in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in (s for s in _xml(z, "xl/workbook.xml").iter() if _local(s) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
            out.append(f"[Sheet: {sheet.get('name')}]")
            for row in (r for r in _xml(z, target if target.startswith("xl/") else f"xl/{target}").iter() if _local(r) == "row"):
                cells = []
                for c in row:
                    value = next((v.text or "" for v in c if _local(v) == "v"), "")
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else _paragraph(c) if c.get("t") == "inlineStr" else value)
                if any(x.strip() for x in cells):
                    out.append("\t".join(cells))
    return "\n".join(out)


@register("pptx", "pptm", "potx", "potm", "ppsx", "ppsm", "ppt")
def pptx(data: bytes) -> str:
    """Each slide's number, its text and the rows of its tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for i, name in enumerate(slides, 1):
            out.append(f"[Slide {i}]")
            root = _xml(z, name)
            inside = {id(p) for t in root.iter() if _local(t) == "tbl" for p in t.iter()}
            out += [t for p in root.iter() if _local(p) == "p" and id(p) not in inside and (t := _paragraph(p)).strip()]
            out += [r for t in root.iter() if _local(t) == "tbl" for r in _table_rows(t)]
    return "\n".join(out)


@register("rtf")
def rtf(data: bytes) -> str:
    """Without control words and groups that carry no text."""
    s = data.decode("latin-1")
    s = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)(?:[^{}]|\{[^{}]*\})*\}", "", s)
    s = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), s)
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "ignore"), s)
    s = re.sub(r"\\(?:par|line|row)\b ?", "\n", s)
    s = re.sub(r"\\(?:tab|cell)\b ?", "\t", s)
    return re.sub(r"[{}]", "", re.sub(r"\\[A-Za-z]+-?\d* ?|\\[^a-zA-Z]", "", s)).strip()


@register("pdf")
def pdf(data: bytes) -> str:
    """Pages that hold text, blank lines between."""
    try:
        import pymupdf

        pages = [p.get_text() for p in pymupdf.open(stream=data, filetype="pdf")]
    except ImportError:
        try:
            import pypdf

            pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]
        except ImportError:
            return ""
    return "\n\n".join(p.strip() for p in pages if p.strip())


@register("doc", "dot")
def doc(data: bytes) -> str:
    with tempfile.NamedTemporaryFile(suffix=".doc") as f:  # a scratch file of this task alone
        f.write(data)
        f.flush()
        try:
            return subprocess.run(["antiword", f.name], capture_output=True, timeout=30, check=True).stdout.decode("utf-8", "ignore")
        except (OSError, subprocess.SubprocessError):
            return docx(data)


@register("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff")
def image(data: bytes) -> str:
    """Size, mode and format, and what is written in the picture where a reader is there."""
    try:
        from PIL import Image
    except ImportError:
        return ""
    with Image.open(io.BytesIO(data)) as im:
        parts = [f"{im.width}x{im.height} {im.mode} {im.format}"]
        try:
            import pytesseract

            parts.append(pytesseract.image_to_string(im).strip())
        except ImportError:
            pass
    return "\n".join(p for p in parts if p)


def extract(name: str, data: bytes | None) -> str:
    """Text of one file; unknown kinds as plain text, unreadable ones empty."""
    return attempted(name, data)[0]


def attempted(name: str, data: bytes | None) -> tuple[str, str | None]:
    """Text of one file, and what went wrong if it could not be read."""
    parser = _PARSERS.get(name.rpartition(".")[2].lower(), plain)
    try:
        return parser(bytes(data or b"")), None
    except Exception as e:  # any broken file of any format: its text is empty, the batch goes on
        return "", f"{type(e).__name__}: {e}"[:200]


@udf.pandas("struct<text:string,error:string>")
def _extract(names: pd.Series, data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([attempted(n or "", d) for n, d in zip(names, data)], columns=["text", "error"])


def parsed(files: DataFrame, most: int | None = None) -> DataFrame:
    """path, modified, length, status, error and text of files as spark.read.format("binaryFile") gives them; files beyond `most` bytes are
    not read. status: success, empty, too large, or error where the parser failed (as for binary .xls and .ppt, which are no archives)."""
    too_large = F.lit(False) if most is None else F.col("length") > most
    rows = files.select("path", F.col("modificationTime").alias("modified"), "length", too_large.alias("_large"), F.when(~too_large, F.col("content")).alias("_data"))
    read = rows.withColumn("_read", _extract("path", "_data")).select("*", "_read.text", "_read.error")
    status = F.when(F.col("_large"), "too large").when(F.col("error").isNotNull(), "error").when(F.length(F.trim("text")) > 0, "success").otherwise("empty")
    return read.select("path", "modified", "length", status.alias("status"), F.when(~F.col("_large"), F.col("error")).alias("error"), F.when(~F.col("_large"), F.col("text")).alias("text"))


@udf.pandas("string")
def html_column(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: html_text(s or ""))


@udf.pandas("string")
def vtt_column(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: vtt_text(s or ""))


@udf.pandas("string")
def csv_column(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: csv_text(s or ""))
