"""Embedding pipeline (V1-V4): user-supplied or hashing embedder, content-addressed cache, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import all_tokens, content_hash


def embed_hashed(texts: DataFrame, dim: int = 1024) -> DataFrame:
    """V1, default: hashed term frequencies on the unit sphere; adds `embedding`."""
    counted = HashingTF(numFeatures=dim, inputCol="__terms", outputCol="__tf").transform(texts.withColumn("__terms", all_tokens(F.col("content"))))
    unit = Normalizer(p=2.0, inputCol="__tf", outputCol="__unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__terms", "__tf", "__unit")


def embed_with(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """V1: a caller's embedder over Arrow batches, `batch` texts a call; adds `embedding`, order kept, counts checked."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for i in range(0, len(p), batch):
                some = p["content"].iloc[i : i + batch].tolist()
                got = embedder(some)
                if len(got) != len(some):
                    raise ValueError("EMBED_COUNT_MISMATCH")
                out += got
            yield p.assign(embedding=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes) + ", embedding array<float>"
    return texts.mapInPandas(run, schema)


def cache_split(texts: DataFrame, cache: DataFrame, model: str, now: Column, ttl_seconds: int = 604_800) -> DataFrame:
    """V2: one row for each distinct content: its hash, and whether the cache has a fresh vector for it."""
    wanted = texts.select(content_hash(F.col("content")).alias("content_hash")).distinct()
    fresh = cache.where((F.col("model") == model) & (F.unix_timestamp("stored_at") + ttl_seconds >= F.unix_timestamp(now))).select("content_hash").distinct().withColumn("hit", F.lit(True))
    return wanted.join(fresh, "content_hash", "left").select("content_hash", F.coalesce("hit", F.lit(False)).alias("hit"))


def embed_with_cache(texts: DataFrame, cache: DataFrame, model: str, now: Column, embed: Callable[[DataFrame], DataFrame] = embed_hashed, ttl_seconds: int = 604_800) -> tuple[DataFrame, DataFrame]:
    """V2: (texts with embedding, cache rows to append); only contents without a fresh vector are embedded."""
    keyed = texts.withColumn("content_hash", content_hash(F.col("content")))
    fresh = cache.where((F.col("model") == model) & (F.unix_timestamp("stored_at") + ttl_seconds >= F.unix_timestamp(now)) & F.col("embedding").isNotNull())
    known = fresh.groupBy("content_hash").agg(F.max_by("embedding", "stored_at").alias("embedding"))
    met = keyed.join(known, "content_hash", "left")
    missing = met.where("embedding is null").drop("embedding")
    made = embed(missing.select("content_hash", "content").dropDuplicates(["content_hash"])).select("content_hash", "embedding")
    return met.where("embedding is not null").unionByName(missing.join(made, "content_hash")), made.select(F.lit(model).alias("model"), "content_hash", "embedding", now.alias("stored_at"))


class BucketedCache:
    """V2's cache as a table of the session's catalog, in buckets of the content hash: a join or an aggregate by hash meets it without a shuffle of its side.

    Rows are added as they come; `compact` writes the next generation of the table, one row of each model and hash, without expired ones, and drops the
    one before. One writer at a time.
    """

    SCHEMA = "model string, content_hash string, embedding array<float>, stored_at timestamp"

    def __init__(self, spark: SparkSession, name: str, buckets: int = 32) -> None:
        self.spark, self.name, self.buckets = spark, name, buckets

    def generations(self) -> list[int]:
        tables = [t.name for t in self.spark.catalog.listTables(pattern=f"{self.name}_g*")]
        return sorted(int(t.rsplit("_g", 1)[1]) for t in tables)

    def read(self) -> DataFrame:
        found = self.generations()
        return self.spark.table(f"{self.name}_g{found[-1]}") if found else self.spark.createDataFrame([], self.SCHEMA)

    def _write(self, rows: DataFrame, generation: int) -> None:
        columns = self.spark.createDataFrame([], self.SCHEMA).columns
        rows.select(*columns).repartition(self.buckets, "content_hash").write.mode("append").bucketBy(self.buckets, "content_hash").sortBy("content_hash").saveAsTable(f"{self.name}_g{generation}")

    def add(self, rows: DataFrame) -> None:
        """Rows of embed_with_cache."""
        self._write(rows, max(self.generations(), default=1))

    def compact(self, now: Column, ttl_seconds: int = 604_800) -> None:
        old = self.generations()
        if not old:
            return
        fresh = self.read().where(F.unix_timestamp("stored_at") + ttl_seconds >= F.unix_timestamp(now))
        last = fresh.groupBy("content_hash", "model").agg(F.max_by(F.struct("embedding", "stored_at"), "stored_at").alias("v")).select("model", "content_hash", "v.embedding", "v.stored_at")
        self._write(last, old[-1] + 1)
        for g in old:
            self.spark.sql(f"drop table {self.name}_g{g}")


def check_vectors(chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """V3: chunks without a vector, or with one of another dimension."""
    out = chunks.select("chunk_id").join(vectors.select("chunk_id", F.size("embedding").alias("dim")), "chunk_id", "left")
    return out.where(F.col("dim").isNull() | (F.col("dim") != dim)).select("chunk_id", F.when(F.col("dim").isNull(), "MISSING").otherwise("EMBED_VECTOR_MISMATCH").alias("error_code"))
