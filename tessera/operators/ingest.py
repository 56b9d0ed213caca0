"""Ingest: identity, duplicates, latest-wins tables, change detection, packing of metadata.

The key of a document is its URI; `seq` is its order of arrival and breaks every tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def exact_duplicates(docs: DataFrame, key: str, content: str) -> DataFrame:
    """fingerprint, first key and number of the documents that share a content."""
    return docs.select(key, T.fingerprint(F.col(content)).alias("fingerprint")).groupBy("fingerprint").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")


def duplicates_of_existing(new: DataFrame, existing: DataFrame) -> DataFrame:
    """uri, duplicate_of for new documents (seq, store, uri, path, fingerprint, aliases) that an earlier one of another path equals in content and in some alias.

    Earlier are all existing documents and the new ones of a smaller seq that are kept themselves, as if new ones arrived one by one. The
    earliest such document counts; a document whose path (in any case) is known already is an update and no duplicate. Only documents that
    share a store and a content meet; a task goes through its groups in order and holds the names of the one at hand.
    """
    columns = ("seq", "store", "uri", "path", "fingerprint", "aliases")
    known = existing.select("store", F.lower("path").alias("_path")).distinct()
    fresh = new.select(*columns, F.lower("path").alias("_path")).join(known, ["store", "_path"], "left_anti").select(*columns, F.lit(True).alias("new"))
    # Contents of new documents alone are looked at.
    old = existing.select(*columns, F.lit(False).alias("new")).join(fresh.select("store", "fingerprint").distinct(), ["store", "fingerprint"], "left_semi")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, uris, paths, names = None, [], set(), {}  # of the kept ones; names: alias -> the first that has it
        for batch in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                _, store, uri, path, fingerprint, aliases, new = r
                if (store, fingerprint) != group:
                    group, uris, paths, names = (store, fingerprint), [], set(), {}
                path, aliases = (path or "").lower(), aliases or []
                known = [names[a] for a in aliases if a in names] if new and not (path and path in paths) else []
                if known:
                    out.append((uri, uris[min(known)]))
                    continue
                for a in aliases:
                    names.setdefault(a, len(uris))
                uris.append(uri)
                paths.add(path)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["uri", "duplicate_of"])

    both = old.select(*columns, "new").unionByName(fresh).repartition("store", "fingerprint")
    return both.sortWithinPartitions("store", "fingerprint", "new", "seq").mapInArrow(settle, "uri string, duplicate_of string")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of every key; of equal versions one of the new rows."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def restore(current: DataFrame, saved: DataFrame, key: str = "uri") -> DataFrame:
    """The current rows and the saved ones whose key is unknown."""
    return current.unionByName(saved.join(current.select(key), key, "left_anti").select(*current.columns))


def insert_absent(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Idempotent creation: rows of new keys are added, known ones stay as they are."""
    return current.unionByName(new.dropDuplicates([key]).join(current.select(key), key, "left_anti").select(*current.columns))


def without_store(df: DataFrame, store: str) -> DataFrame:
    return df.where(F.col("store") != store)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, changed, deleted) between two listings of path, size and digest."""
    b, a = before.select("path", F.struct("size", "digest").alias("b")), after.select("path", F.struct("size", "digest").alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def stale(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose text is not in the parsed table, or was parsed before they changed."""
    return files.join(parsed.select("path", "modified"), ["path", "modified"], "left_anti")


_LETTERS = "A accessed_at|B is_binary|C created_at|D description|E encoding|F file_name|G tags|H content_hash|I mime_type|L lines_of_code|M modified_at|O permissions|P file_path|S size_bytes|T file_type|X checksum"
FIELDS = {name: letter for letter, name in (x.split() for x in _LETTERS.split("|"))}
PATHS = {f"/{x}/": f"[{x[0].upper()}]" for x in ("var", "root", "home")} | {f"{x}:\\": f"[{x}]" for x in "CD"}
_SHORT = {"docx": "dx", "xlsx": "xls"}
KINDS = {f".{x}": f"[*{_SHORT.get(x, x)}]" for x in sorted("bat css docx html js json md pdf py sh sql ts txt xlsx xml yaml".split())}
FLAGS = dict(zip(("error", "false", "indexed", "pending", "true"), "-N10Y"))


def _swap(c: Column, pairs: dict[str, str], whole: bool = False) -> Column:
    if whole:
        table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
        return F.coalesce(F.element_at(table, c), c)
    for a, b in pairs.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def pack(metadata: Column) -> Column:
    """A map with short keys, and short forms of path heads, extensions and flags in its values."""
    ends = sorted(KINDS.items(), key=lambda kv: -len(kv[0]))
    named = F.transform_keys(metadata, lambda k, v: _swap(k, FIELDS, whole=True))
    return F.transform_values(named, lambda k, v: _swap(_swap(_swap(v, PATHS), dict(ends)), FLAGS, whole=True))


def unpack(packed: Column) -> Column:
    def back(d: dict[str, str]) -> dict[str, str]:
        return {b: a for a, b in d.items()}

    named = F.transform_keys(packed, lambda k, v: _swap(k, back(FIELDS), whole=True))
    return F.transform_values(named, lambda k, v: _swap(_swap(_swap(v, back(FLAGS), whole=True), back(KINDS)), back(PATHS)))


def compression(before: Column, after: Column) -> Column:
    return F.when(F.length(before) > 0, F.round(1 - F.length(after) / F.length(before), 4)).otherwise(0.0)


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") != "success").alias("failed"))


RESERVED = "con prn aux nul com1 com2 com3 com4 lpt1 lpt2 lpt3 lpt4".split()


def filename_problem(name: Column) -> Column:
    """Why a file name is refused; null where it is fine."""
    return (
        F.when(F.length(F.trim(T.text(name))) == 0, F.lit("empty"))
        .when(F.contains(name, F.lit("..")) | name.rlike(r"[/\\]"), F.lit("traversal"))
        .when(F.startswith(name, F.lit(".")), F.lit("hidden"))
        .when(F.length(name) > 200, F.lit("too long"))
        .when(name.rlike(r'["*<>?|:\x00-\x1f]'), F.lit("characters"))
        .when(F.lower(F.regexp_extract(name, r"^([^.]*)", 1)).isin(RESERVED), F.lit("reserved"))
    )


def query_problem(query: Column) -> Column:
    n = F.length(F.trim(T.text(query)))
    return F.when(n == 0, F.lit("empty")).when(F.length(query) > 1000, F.lit("too long")).when(F.lower(query).rlike(r"<script|javascript:|drop\s+table|union\s+select"), F.lit("pattern"))


def validated_answer(answer: Column, banned: list[str], most: int = 4096) -> Column:
    """The answer, cut, with whether it is free of banned terms."""
    cut = F.substring(T.text(answer), 1, most)
    low = F.lower(cut)
    fine = ~F.exists(F.array(*(F.lit(b.lower()) for b in banned)), lambda b: F.contains(low, b)) if banned else F.lit(True)
    return F.struct(cut.alias("answer"), fine.alias("ok"))
