"""API keys as a table: key_id, name, key_hash, user_id, created_at, is_active, permissions. Keys themselves are never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ingest


def key_hash(key: Column) -> Column:
    return F.sha2(key.cast("binary"), 256)


def issue(keys: DataFrame, new: DataFrame) -> DataFrame:
    """Keys with the new ones (the same columns, `key` instead of key_hash); an id that is known keeps its row."""
    hashed = new.withColumn("key_hash", key_hash(F.col("key"))).drop("key").withColumn("is_active", F.lit(True)).select(*keys.columns)
    return ingest.insert_absent(keys, hashed, "key_id")


def revoke(keys: DataFrame, ids: DataFrame) -> DataFrame:
    """Keys of which those in ids (key_id) are no longer active."""
    gone = ids.select("key_id", F.lit(True).alias("_gone")).distinct()
    return keys.join(gone, "key_id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).select(*keys.columns)


def of_user(keys: DataFrame, user: str) -> DataFrame:
    """A user's keys, the newest first, with their permissions as an array."""
    parsed = F.from_json("permissions", "array<string>")
    return keys.where(F.col("user_id") == user).withColumn("permissions", parsed).orderBy(F.col("created_at").desc(), "key_id")


def authenticated(requests: DataFrame, keys: DataFrame, permission: str) -> DataFrame:
    """Requests (with `key`) and whether an active key with the permission stands behind them."""
    known = keys.select("key_hash", "key_id", "is_active", F.from_json("permissions", "array<string>").alias("_may"))
    joined = requests.withColumn("key_hash", key_hash(F.col("key"))).join(known, "key_hash", "left")
    allowed = F.coalesce(F.col("is_active") & F.array_contains("_may", permission), F.lit(False))
    return joined.withColumn("allowed", allowed).drop("key", "key_hash", "is_active", "_may")
