"""Approximate dense search (R3): hash buckets of random hyperplanes, several tables, several probes; candidates get exact scores.

A table cuts the sphere by `bits` hyperplanes; a vector's code is the side it lies on of each. A question looks into the bucket of its own code and
into those that differ by the planes it lies nearest to, cheapest first. How many buckets reach a wanted recall depends on the vectors, so it is
measured: `fit_probes` takes a bounded sample of questions, searches them exactly and finds at which probe each true neighbour turns up.

Every vector is in the index. Codes are computed over Arrow batches by one matrix product; the join of probes and index, on repository, table
and code, and all scores are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators.retrieval import dense_search, dot
from corpusmill.sources.tables import discard, durable

#: Planes of a table, tables, and questions of the sample that probes are fitted on at most.
BITS, TABLES, MAX_SAMPLE = 8, 6, 200


def hyperplanes(dim: int, bits: int, tables: int, seed: int = 0) -> np.ndarray:
    """(dim, tables * bits), the same for the same numbers."""
    return np.random.default_rng(seed).standard_normal((dim, tables * bits)).astype(np.float32)


def _sides(b: pa.RecordBatch, dim: int, planes: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables, bits): signed distances to the planes."""
    x = b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    return (x @ planes).reshape(len(x), tables, -1)


def _fitting(rows: DataFrame, dim: int) -> DataFrame:
    return rows.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda v: v.isNull()))


def build_vector_index(vectors: DataFrame, dim: int, bits: int = BITS, tables: int = TABLES, seed: int = 0) -> DataFrame:
    """(repo_id, chunk_id, table_no, code) of vectors (repo_id, chunk_id, embedding), one row for each table. Vectors of another dimension are left out."""
    planes = hyperplanes(dim, bits, tables, seed)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = (_sides(b, dim, planes, tables) > 0) @ (1 << np.arange(bits))
            rows = pa.array(np.repeat(np.arange(b.num_rows), tables))
            yield pa.RecordBatch.from_arrays([b["repo_id"].take(rows), b["chunk_id"].take(rows), pa.array(np.tile(np.arange(tables, dtype=np.int32), b.num_rows)), pa.array(codes.ravel().astype(np.int32))], ["repo_id", "chunk_id", "table_no", "code"])

    known = _fitting(vectors.where("chunk_id is not null"), dim).select("repo_id", "chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
    kinds = dict(known.dtypes)
    return known.mapInArrow(code, f"repo_id {kinds['repo_id']}, chunk_id {kinds['chunk_id']}, table_no int, code int")


def _costs(sides: np.ndarray) -> np.ndarray:
    """(rows, tables, 2^bits): for each set of planes to cross, the sum of squared distances to them."""
    bits = sides.shape[-1]
    sets = (np.arange(1 << bits)[:, None] >> np.arange(bits) & 1).astype(np.float32)
    return (sides**2) @ sets.T


def probe(questions: DataFrame, dim: int, probes: int, bits: int = BITS, tables: int = TABLES, seed: int = 0) -> DataFrame:
    """(query_id, repo_id, table_no, code): the buckets that questions (query_id, repo_id, embedding) look into, `probes` in each table."""
    planes = hyperplanes(dim, bits, tables, seed)
    each = min(probes, 1 << bits)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = _sides(b, dim, planes, tables)
            own = (sides > 0) @ (1 << np.arange(bits))
            codes = own[:, :, None] ^ np.argsort(_costs(sides), axis=2, kind="stable")[:, :, :each]
            rows = pa.array(np.repeat(np.arange(b.num_rows), tables * each))
            yield pa.RecordBatch.from_arrays([b["query_id"].take(rows), b["repo_id"].take(rows), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), b.num_rows)), pa.array(codes.ravel().astype(np.int32))], ["query_id", "repo_id", "table_no", "code"])

    asked = _fitting(questions, dim).select("query_id", "repo_id", F.col("embedding").cast("array<float>").alias("embedding"))
    kinds = dict(asked.dtypes)
    return asked.mapInArrow(look, f"query_id {kinds['query_id']}, repo_id {kinds['repo_id']}, table_no int, code int")


def fit_probes(vectors: DataFrame, questions: DataFrame, dim: int, recall: float = 0.95, limit: int = 10, bits: int = BITS, tables: int = TABLES, seed: int = 0, most: int = MAX_SAMPLE) -> int:
    """The least number of probes in each table that finds that share of the nearest `limit` vectors of a sample of the questions.

    The sample is the `most` questions with the least hash of their query_id; for each pair of a question and a true neighbour the first table that
    has the neighbour counts. At most most * limit numbers reach the driver.
    """
    planes = hyperplanes(dim, bits, tables, seed)

    def first_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = _sides(b.select(["embedding"]), dim, planes, tables)
            there = _sides(pa.RecordBatch.from_arrays([b["other"]], ["embedding"]), dim, planes, tables)
            crossed = ((asked > 0) ^ (there > 0)) @ (1 << np.arange(bits))
            costs = _costs(asked)
            own = np.take_along_axis(costs, crossed[:, :, None], axis=2)
            nth = (costs < own).sum(axis=2) + 1
            yield pa.RecordBatch.from_arrays([pa.array(nth.min(axis=1).astype(np.int64))], ["nth"])

    sample = durable(_fitting(questions, dim).select("query_id", "repo_id", "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(most), "sample")
    best = dense_search(_fitting(vectors, dim), sample, limit).select("query_id", "repo_id", "chunk_id")
    pairs = best.join(sample, ["query_id", "repo_id"]).join(vectors.select("repo_id", "chunk_id", F.col("embedding").alias("other")), ["repo_id", "chunk_id"])
    found = pairs.select(*[F.col(c).cast("array<float>").alias(c) for c in ("embedding", "other")]).mapInArrow(first_found, "nth long").toPandas()["nth"].sort_values().to_numpy()
    discard(sample)
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) if len(found) else 1


def approximate_search(vectors: DataFrame, index: DataFrame, questions: DataFrame, dim: int, probes: int, limit: int = 20, bits: int = BITS, tables: int = TABLES, seed: int = 0) -> DataFrame:
    """R3, approximate: as dense_search, but among the vectors of the buckets that a question looks into; (query_id, repo_id, chunk_id, score, rank).

    The index's bits, tables and seed must be those given here. Ids meet first, vectors last; each task keeps its own best before the shuffle.
    """
    met = probe(questions, dim, probes, bits, tables, seed).join(index, ["repo_id", "table_no", "code"]).select("query_id", "repo_id", "chunk_id").distinct()
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    asked = questions.select("query_id", "repo_id", F.col("embedding").alias("asked"), norm.alias("asked_norm"))
    known = vectors.where("chunk_id is not null").select("repo_id", "chunk_id", "embedding", norm.alias("norm"))
    cosine = dot(F.col("asked"), F.col("embedding")) / (F.col("asked_norm") * F.col("norm"))
    scored = met.join(known, ["repo_id", "chunk_id"]).join(asked, ["query_id", "repo_id"]).select("query_id", "repo_id", "chunk_id", F.bround(cosine, 4).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id", "repo_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= limit)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact search's rows that the other has, one that scores as well counting too where scores tie."""
    last = exact.groupBy("query_id", "repo_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = found.join(last, ["query_id", "repo_id"]).where("score >= least").groupBy("query_id", "repo_id").agg(F.least(F.count("*"), F.max("n")).alias("hits"))
    total = last.join(hits, ["query_id", "repo_id"], "left").agg(F.sum(F.coalesce("hits", F.lit(0))).alias("hits"), F.sum("n").alias("n")).first()
    return (total.hits or 0) / total.n if total.n else 1.0
