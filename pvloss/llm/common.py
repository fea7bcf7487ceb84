"""Helpers that several operators share: tables, and the shared folder where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one
    machine (as in tests) gets a new local one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pvloss-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """df written to the shared folder and read back: it survives a lost executor and is computed once."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_IDS, SLOTS = 1_000_000, 1 << 22


def split_by_ids(docs: DataFrame, some: DataFrame, key: str = "doc_id", most: int = BROADCAST_IDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """docs whose key is not in `some` (a column named key; null is a value like any other), and those whose
    key is. Up to `most` keys are broadcast. More are hashed into `slots` places, whose list is broadcast:
    rows at a free place stay without a shuffle, only the others are shuffled to be compared exactly."""
    keys = stored(some.select(F.col(key).alias("_some")).distinct(), "keys")
    same = docs[key].eqNullSafe(keys["_some"])
    if keys.count() <= most:
        return docs.join(F.broadcast(keys), same, "left_anti"), docs.join(F.broadcast(keys), same, "left_semi")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)).cast("int")
    taken = F.broadcast(keys.select(place("_some").alias("_taken")).distinct())
    at = place(docs[key]) == taken["_taken"]
    near = docs.join(taken, at, "left_semi")
    exact = near[key].eqNullSafe(keys["_some"])
    return docs.join(taken, at, "left_anti").unionByName(near.join(keys, exact, "left_anti")), near.join(keys, exact, "left_semi")
