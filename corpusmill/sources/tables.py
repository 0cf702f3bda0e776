"""Sources and sinks (S1-S10): trees of files, guarded sets of files, snapshot and upsert tables, evaluation files."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: What counts as source.
SUFFIXES = ("py", "js", "ts", "tsx", "jsx", "go", "java", "cpp", "c", "h", "hpp", "rs", "php", "rb", "cs", "md", "rst", "sql", "yaml", "yml", "toml", "ini", "cfg", "env", "sh", "tf")
FILE_NAMES = ("dockerfile", "makefile", "procfile")
SKIPPED_DIRS = (".git", "node_modules", ".venv", "venv", "dist", "build", "__pycache__")


#: The folder of a local master without spark.checkpoint.dir, which can't be set in a running session; for each application.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a temporary one, gone at exit; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        made = _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{_local_folders[context.applicationId]}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, forgets partitioning."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.durable_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete durable tables that no frame still to be computed reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.durable_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def join_few(left: DataFrame, right: DataFrame, keys: list[str], parts: int = 1000) -> DataFrame:
    """left join of left (a durable table) to right's only row of a key, inner, whatever left's keys.

    Keys that at least 1 / parts of left's rows have are counted; there can be `parts` of them at most, so their rows of right are broadcast and left's stay where
    they are. The rest goes by an ordinary join.
    """
    least = max(2, -(-left.count() // parts))
    heavy = durable(left.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*keys), "heavy")
    if heavy.isEmpty():
        return left.join(right, keys)
    hot = left.join(F.broadcast(right.join(F.broadcast(heavy), keys, "left_semi")), keys)
    return hot.unionByName(left.join(F.broadcast(heavy), keys, "left_anti").join(right, keys))


def read_source_tree(spark: SparkSession, root: str, repo_id: str, only_source: bool = False) -> DataFrame:
    """files(repo_id, file_path, content) under root, path relative to it, bytes that are no UTF-8 dropped.

    only_source: S2 holds for the listing already. Spark prunes files by a filter on their hidden path, so skipped folders and suffixes are neither
    opened nor given to a task; what is left is dealt over tasks by its sizes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    relative = lambda path: F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:/*", "/"), "^" + _quoted(base) + "/", "")
    if only_source:
        raw = raw.where(is_source_file(relative(F.col("_metadata.file_path"))))
    path = relative("path")
    return raw.select(F.lit(repo_id).alias("repo_id"), path.alias("file_path"), text.alias("content"))


def _quoted(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def is_source_file(path: Column) -> Column:
    """S2"""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    suffix = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return (suffix.isin(*SUFFIXES) | name.isin(*FILE_NAMES)) & ~F.arrays_overlap(F.concat(dirs, F.array(F.lit(""))), F.array(*[F.lit(d) for d in SKIPPED_DIRS]))


def filter_source_files(files: DataFrame) -> DataFrame:
    return files.where(is_source_file(F.col("file_path")))


def capacity_guard(rows: DataFrame, limit: int, code: str) -> DataFrame:
    """S3: one row for each repository: its count, and the error code where it is over the limit."""
    return rows.groupBy("repo_id").agg(F.count("*").alias("n")).select("repo_id", "n", F.when(F.col("n") > limit, code).alias("error_code"))


def within_capacity(rows: DataFrame, guard: DataFrame) -> DataFrame:
    return rows.join(guard.where("error_code is not null").select("repo_id"), "repo_id", "left_anti")


def replace_chunks(chunks: DataFrame, path: str) -> None:
    """Overwrite the partitions of the repositories that chunks holds; others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def newest(rows: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(when), F.desc(tie)))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def upsert_analysis(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One result for each job_id, the newest of both tables."""
    return newest(existing.unionByName(incoming), ["job_id"], "created_at", "quality_score")


#: Fields of a repository that a new snapshot replaces, by null too. Fixed values.
REPOSITORY_FIELDS = ("github_url", "owner", "name", "default_branch", "latest_commit_sha", "description", "stars", "forks", "language", "size_kb")


def upsert_repositories(existing: DataFrame, incoming: DataFrame, fields: tuple[str, ...] = REPOSITORY_FIELDS) -> DataFrame:
    """By full_name; the newest snapshot wins on every mutable field, the first id stays."""
    fresh = incoming.groupBy("full_name").agg(F.max_by(F.struct("id", *fields), F.struct("snapshot_at", "id")).alias("n"))
    both = existing.join(fresh, "full_name", "full_outer")
    return both.select("full_name", F.coalesce("id", "n.id").alias("id"), *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def latest_commit_diff(diffs: DataFrame, head_sha: Column | None = None) -> DataFrame:
    """The newest diff of each repository, of one head if asked for."""
    return newest(diffs if head_sha is None else diffs.where(head_sha), ["repo_id"], "created_at", "head_sha")


EVAL_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("run_id", T.StringType()), ("repo_key", T.StringType()), ("question_id", T.StringType()), ("status", T.StringType()), ("latency_ms", T.DoubleType()), ("citation_count", T.IntegerType()))])


def read_eval(spark: SparkSession, path: str, schema: T.StructType = EVAL_SCHEMA) -> DataFrame:
    """JSON lines (blank lines skipped), or CSV with a header."""
    return spark.read.schema(schema).csv(path, header=True) if path.endswith(".csv") else spark.read.schema(schema).json(path)


def write_eval(df: DataFrame, path: str) -> None:
    """One JSON object a line, or CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True) if path.endswith(".csv") else df.write.mode("overwrite").json(path)


def export_shared_analysis(tokens: DataFrame, repositories: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """For usable tokens, the repository and its newest analysis as JSON; what is missing is an empty object."""
    usable = tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    last = newest(results, ["repo_id"], "created_at", "job_id").select("repo_id", "quality_score", "languages")
    flat = F.to_json(F.coalesce("languages", F.create_map().cast("map<string,double>")))
    return usable.join(repositories, "repo_id").join(last, "repo_id", "left").select("share_id", "repo_id", "full_name", "quality_score", flat.alias("languages_json"))
