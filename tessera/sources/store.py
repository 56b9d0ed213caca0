"""Tables on disk: stores, snapshots, latest-wins writes, files and their listings."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from . import parsers

SNAPSHOT = "schema_version int, store_name string, saved_at string, doc_count long, atom_count long, docs array<struct<title:string,uri:string,content:string>>, atoms array<struct<title:string,uri:string,content:string>>"
VERSION = 1


def read_files(spark: SparkSession, path: str, *patterns: str) -> DataFrame:
    """The files below a folder with their bytes; a pattern prunes them before they are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if patterns:
        reader = reader.option("pathGlobFilter", "{" + ",".join(patterns) + "}" if len(patterns) > 1 else patterns[0])
    return reader.load(path)


def listing(files: DataFrame, head: int = 1 << 20) -> DataFrame:
    """path, size and digest of the first `head` bytes."""
    return files.select("path", F.col("length").alias("size"), F.sha1(F.substring("content", 1, head)).alias("digest"))


def ingest_files(spark: SparkSession, path: str, store: str, most: int = 50 << 20) -> DataFrame:
    """store, uri, title, path, content, fingerprint, status of the files below a folder."""
    from ..functions import text as T

    rows = parsers.parsed(read_files(spark, path), most)
    local = F.regexp_replace("path", "^file:/+", "/")
    return rows.select(F.lit(store).alias("store"), T.document_uri(F.lit(store), local).alias("uri"), T.file_name(local).alias("title"), local.alias("path"), F.coalesce("text", F.lit("")).alias("content"), T.fingerprint(F.col("text")).alias("fingerprint"), "status")


def write_store(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the stores that df has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store").parquet(path)


def read_store(spark: SparkSession, path: str, store: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if store is None else df.where(F.col("store") == store)


def stores(df: DataFrame) -> DataFrame:
    return df.select("store").distinct().orderBy("store")


def upsert_store(new: DataFrame, path: str, keys: list[str], version: str) -> DataFrame:
    """The table of `path` with the newest row of every key; only stores that new rows touch are read and written again."""
    spark = new.sparkSession
    touched = [r.store for r in new.select("store").distinct().collect()]
    merged = ingest.upsert(read_store(spark, path).where(F.col("store").isin(touched)), new, keys, version)
    scratch = f"{path.rstrip('/')}-next-{uuid.uuid4().hex}"  # a table cannot be written while it is read
    merged.write.parquet(scratch)
    write_store(spark.read.parquet(scratch), path)
    _delete(spark, scratch)
    return read_store(spark, path)


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def delete_store(spark: SparkSession, store: str, tables: list[str], snapshot: str | None = None) -> int:
    """Deletes a store everywhere: its partition of every table (documents, chunks, vectors; each written by store) and its snapshot.

    Returns how many of these there were; nothing of other stores is read or written, and a second call finds nothing.
    """
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(store)
    return sum(_delete(spark, path) for path in [*(f"{t.rstrip('/')}/store={name}" for t in tables), *([snapshot] if snapshot else [])])


def export_snapshot(docs: DataFrame, atoms: DataFrame, store: str, saved_at: str) -> DataFrame:
    """One JSON row of a store, as text."""
    d = docs.agg(F.sort_array(F.collect_list(F.struct("seq", "title", "uri", "content"))).alias("d"), F.count("*").alias("doc_count"))
    a = atoms.agg(F.sort_array(F.collect_list(F.struct("seq", "title", "uri", "content"))).alias("a"), F.count("*").alias("atom_count"))

    def bare(name: str):
        return F.transform(name, lambda x: F.struct(x["title"].alias("title"), x["uri"].alias("uri"), x["content"].alias("content")))

    row = F.struct(F.lit(VERSION).alias("schema_version"), F.lit(store).alias("store_name"), F.lit(saved_at).alias("saved_at"), "doc_count", "atom_count", bare("d").alias("docs"), bare("a").alias("atoms"))
    return d.crossJoin(a).select(F.to_json(row).alias("value"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """store, title, uri, content of a snapshot's documents; broken files and other versions give nothing."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", SNAPSHOT).alias("s")).where(F.col("s.schema_version") == VERSION)
    return raw.select(F.col("s.store_name").alias("store"), F.explode("s.docs").alias("d")).select("store", "d.*")


def load_synonyms(path: str) -> dict[str, list[str]]:
    """Term to synonyms from a JSON object; missing or broken files give none."""
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    return {k.lower(): [str(x) for x in v] for k, v in found.items() if isinstance(v, list)} if isinstance(found, dict) else {}


def table_sizes(files: DataFrame) -> DataFrame:
    """Bytes and files by folder, from a listing."""
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
