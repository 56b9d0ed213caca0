"""Vectors as arrays: products, norms, feature hashing, quantisation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import udf
from .text import let

DIMENSIONS = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero vectors count as of length 1."""
    na, nb = norm(a), norm(b)
    return dot(a, b) / (F.when(na == 0, 1.0).otherwise(na) * F.when(nb == 0, 1.0).otherwise(nb))


def unit(a: Column) -> Column:
    return let(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n > 1e-10, n).otherwise(1.0)))


def blend(a: Column, b: Column, weight_a: float, weight_b: float) -> Column:
    return let(F.zip_with(a, b, lambda x, y: F.lit(weight_a) * x + F.lit(weight_b) * y), unit)


def embedding_text(c: Column) -> Column:
    """Lower-case words, dots, dashes, slashes; white space as single spaces; at most 512 characters."""
    kept = F.regexp_replace(F.regexp_replace(T.lower_trim(c), r"(?U)\s+", " "), r"(?U)[^\w\s.\-_/]", "")
    return F.substring(kept, 1, 512)


#: Features whose digests a task remembers (most recur from text to text), and texts that it reads at once.
MEMORY, TEXTS = 1 << 18, 512
#: Characters of a task have numbers of so many bits, so that five fit a feature's code.
_BITS = 12


class _Hasher:
    """Sums of signed features. Runs of characters are numbers put together from the numbers of their characters, from 1 on, so that each is looked
    up once for many texts and runs of different lengths never share a number."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}  # feature -> twice its place, plus 1 where the sign is negative
        self.runs: dict[int, int] = {}
        self.letters = np.zeros(0x110000, dtype=np.int16)
        self.alphabet = [""]

    def place(self, feature: str) -> int:
        d = hashlib.sha256(feature.encode()).digest()
        return int.from_bytes(d[:4], "big") % self.dimensions * 2 + d[7] % 2

    def sums(self, texts: list[str]) -> np.ndarray:
        if len(self.words) + len(self.runs) > MEMORY:
            self.clear()
        padded = [f" {s} " for s in texts]
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        fresh = np.unique(points[self.letters[points] == 0])
        if len(self.alphabet) + len(fresh) > 1 << _BITS:
            self.clear()
            fresh = np.unique(points)
        if len(fresh) >= 1 << _BITS:
            return np.concatenate([self.sums(texts[: len(texts) // 2]), self.sums(texts[len(texts) // 2 :])])
        self.letters[fresh] = np.arange(len(self.alphabet), len(self.alphabet) + len(fresh))
        self.alphabet += map(chr, fresh.tolist())
        letter, blank = self.letters[points].astype(np.int64), points == 32
        lengths = np.array([len(s) for s in padded])
        text, left = np.repeat(np.arange(len(texts)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
        codes, where = [], []
        for n in (3, 4, 5):
            m = max(0, len(points) - n + 1)
            code, bare = np.zeros(m, dtype=np.int64), np.ones(m, dtype=bool)
            for i in range(n):
                code |= letter[i : i + m] << (_BITS * (n - 1 - i))
                bare &= blank[i : i + m]
            kept = (left[:m] >= n) & ~bare
            codes.append(code[kept])
            where.append(text[:m][kept])
        distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
        distinct = distinct.tolist()
        for c in [c for c in distinct if c not in self.runs]:
            self.runs[c] = self.place("c:" + self.letters_of(c))
        places = np.fromiter(map(self.runs.__getitem__, distinct), np.int64, len(distinct))[at]
        words, own, known = [], [], self.words
        for i, s in enumerate(texts):
            for w in s.split(" "):
                if len(w) > 1:
                    p = known.get(w)
                    words.append(known.setdefault(w, self.place("w:" + w)) if p is None else p)
                    own.append(i)
        place = np.concatenate([places, np.array(words, dtype=np.int64)])
        cell = np.concatenate([*where, np.array(own, dtype=np.int64)]) * self.dimensions + (place >> 1)
        weight = (1.0 - 2.0 * (place & 1)) * np.repeat([1.0, 2.0], [len(places), len(words)])
        return np.bincount(cell, weight, minlength=len(texts) * self.dimensions).reshape(len(texts), self.dimensions)

    def letters_of(self, code: int) -> str:
        out = ""
        while code:
            out, code = self.alphabet[code & ((1 << _BITS) - 1)] + out, code >> _BITS
        return out


def hashed(df: DataFrame, key: str, content: str, dimensions: int = DIMENSIONS, *carried: str) -> DataFrame:
    """key, carried columns, embedding: signed feature hashing to a unit vector (SHA-256: four bytes choose the place, four the sign) of the words of two letters and
    more at weight 2 (w:) and the runs of 3 to 5 characters at weight 1 (c:).

    A text has some 1500 features, so they are summed where the text is, in Arrow batches, instead of being exploded and shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(dimensions)
        for batch in batches:
            for lo in range(0, len(batch), TEXTS):
                part = batch.slice(lo, TEXTS)
                out = hasher.sums([s or "" for s in part.column(len(names) - 1).to_pylist()])
                size = np.linalg.norm(out, axis=1, keepdims=True)
                flat = pa.array((out / np.where(size > 1e-10, size, 1)).ravel())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dimensions), flat)], names=names)

    names = [key, *carried, "embedding"]
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in names[:-1]), "embedding array<double>"])
    return df.select(*names[:-1], embedding_text(F.col(content)).alias("_t")).mapInArrow(run, schema)


def quantise(v: Column) -> Column:
    """Per vector: least value, step and codes 0 to 255."""
    step = F.when(F.array_max(v) > F.array_min(v), (F.array_max(v) - F.array_min(v)) / 255.0).otherwise(F.lit(1.0))

    def codes(g: Column) -> Column:
        inside = F.transform(v, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x - g["low"]) / g["step"]).cast("int"))))
        return F.struct(g["low"].alias("low"), g["step"].alias("step"), inside.alias("codes"))

    return let(F.struct(F.array_min(v).cast("double").alias("low"), step.cast("double").alias("step")), codes)


def dequantise(q: Column) -> Column:
    return let(q, lambda x: F.transform(x["codes"], lambda c: x["low"] + c * x["step"]))


def grid_codes(v: Column, offset: Column, scale: Column) -> Column:
    """Codes -128 to 127 on a grid that all vectors share; values beyond it are clipped."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), ((x.cast("double") - offset) / scale).cast("int"))))


@udf.pandas("array<double>")
def image_vector(data: pd.Series) -> pd.Series:
    """A unit vector made of a chain of digests of a picture's bytes; zeros for no bytes."""
    out = []
    for picture in data:
        raw = bytes(picture or b"")
        link, chain = hashlib.sha256(raw).digest(), b""
        while raw and len(chain) < DIMENSIONS:
            chain += link
            link = hashlib.sha256(link + raw[:16]).digest()
        v = np.frombuffer(chain[:DIMENSIONS], dtype=np.uint8) / 128.0 - 1 if raw else np.zeros(DIMENSIONS)
        n = np.linalg.norm(v)
        out.append(v / n if n > 1e-10 else v)
    return pd.Series(out)
