"""Structured Streaming forms of the job-state operators (J3, J6, J7, E1, E12, J11). State is bounded by watermarks and event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from corpusmill.operators.analysis import analyze_repos
from corpusmill.operators.chunking import chunk_files
from corpusmill.operators.embedding import check_vectors, embed_hashed, embed_with_cache
from corpusmill.operators.evaluation import client_event_rollup
from corpusmill.operators.jobs import LIMITS, dead_letters, known_jobs, limit_of, route_failures
from corpusmill.sources.snapshots import Batch, SnapshotStore, StoredTable, latest, replaced
from corpusmill.sources.tables import capacity_guard, discard, durable, filter_source_files, upsert_analysis, within_capacity


class _InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then hands them to `step` in the order of their time and number.

    Rows are kept as a list state and released by event-time timers, one for each second that rows of a micro-batch fall in. What a step keeps is one value
    state; it is dropped when the watermark passes what `until` says and no row waits.
    """

    #: Columns of the rows that are held, their number first and `at`, microseconds, second; of the value state; of the output.
    held: dict[str, str]
    kept: dict[str, str]
    out: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        spell = lambda fields: ", ".join(f"{c} {kind}" for c, kind in fields.items())
        self.handle = handle
        self.rows = handle.getListState("rows", spell(self.held))
        self.value = handle.getValueState("value", spell(self.kept))

    def step(self, key: tuple, value: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        """The new value and what comes out for a row, if anything."""
        raise NotImplementedError

    def until(self, value: tuple) -> int:
        """Milliseconds of the event time at which the value may be dropped."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            some = some[list(self.held)]
            self.rows.appendList(list(some.astype(object).where(some.notna(), None).itertuples(index=False, name=None)))
            for second in (-(-some["at"] // 1_000_000)).unique():
                self.handle.registerTimer(int(second) * 1000)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = list(self.rows.get()) if self.rows.exists() else []
        due = sorted((r for r in held if r[1] <= passed * 1000), key=lambda r: (r[1], r[0]))
        value = self.value.get() if self.value.exists() else None
        out = []
        for row in due:
            value, said = self.step(key, value, tuple(row))
            if said is not None:
                out.append(said)
        if due:
            wait = [tuple(r) for r in held if r[1] > passed * 1000]
            self.rows.put(wait) if wait else self.rows.clear()
            self.value.update(value)
            self.handle.registerTimer(self.until(value))
        elif value is not None and not held and self.until(value) <= passed:
            self.value.clear()
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


class _Changes(_InOrder):
    """Keeps the last state of a job; lets changes through until a terminal one."""

    held = {"event_id": "long", "at": "long", "status": "string", "progress": "int", "error_message": "string"}
    kept = {"mark": "string", "ended": "boolean", "at": "long"}
    out = ["job_id", "event_id", "status", "progress"]

    def __init__(self, keep_seconds: int) -> None:
        self.keep_seconds = keep_seconds

    def step(self, key, value, row):
        event_id, at, status, progress, error = row
        mark, ended, _ = value or (None, False, 0)
        now = f"{status}|{progress}|{error or ''}"
        said = (key[0], event_id, status, progress) if not ended and now != mark else None
        return (now, bool(ended or status in ("done", "failed")), at), said

    def until(self, value):
        return value[2] // 1000 + self.keep_seconds * 1000


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("ts", F.coalesce("ts", F.timestamp_micros(F.lit(0)))).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))


def status_changes_stream(history: DataFrame, late: str = "10 minutes", keep_seconds: int = 7 * 86_400) -> DataFrame:
    """Needs the RocksDB state store provider. Rows may come in any order within `late`; they take effect in theirs, behind the watermark.

    A job's state is dropped keep_seconds of event time after its last row; a state that comes later counts as new.
    """
    return _timed(history, late).groupBy("job_id").transformWithStateInPandas(_Changes(keep_seconds), "job_id string, event_id long, status string, progress int", "append", "eventTime")


class _Limits(_InOrder):
    """Keeps start and count of an identity's window; a request past its end opens the next."""

    held = {"request_id": "long", "at": "long", "most": "int"}
    kept = {"start": "long", "n": "long"}
    out = ["scope", "identity_type", "identity", "request_id", "allowed", "remaining"]

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def step(self, key, value, row):
        request_id, at, most = row
        start, n = value or (at, 0)
        if at >= start + self.seconds * 1_000_000:
            start, n = at, 0
        return (start, n + 1), (*key, request_id, n + 1 <= most, max(most - n - 1, 0))

    def until(self, value):
        return value[0] // 1000 + self.seconds * 1000


def rate_limit_stream(requests: DataFrame, limits: dict[str, int] | None = None, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Requests may come in any order within `late`; they are counted in theirs, behind the watermark. An identity's window is dropped at its end."""
    timed = _timed(requests, late).withColumn("most", limit_of(F.col("identity_type"), limits or LIMITS))
    schema = "scope string, identity_type string, identity string, request_id long, allowed boolean, remaining int"
    return timed.groupBy("scope", "identity_type", "identity").transformWithStateInPandas(_Limits(seconds), schema, "append", "eventTime")


class _Requests(_InOrder):
    """Keeps the newest job made for a commit, and for each of its keys."""

    held = {"request_id": "long", "at": "long", "idempotency_key": "string", "force": "boolean", "keyed": "struct<job_id:string,done:boolean>", "live": "struct<job_id:string,done:boolean>"}
    kept = {"job_id": "string", "by_key": "map<string,string>", "at": "long"}
    out = ["request_id", "job_id", "cache_hit", "created"]

    def __init__(self, keep_seconds: int) -> None:
        self.keep_seconds = keep_seconds

    def step(self, key, value, row):
        request_id, at, own, force, keyed, live = row
        made, by_key, _ = value or (None, {}, 0)
        by_key = dict(by_key or {})
        if not force:
            used = (by_key[own], False) if own in by_key else keyed or ((made, False) if made else live)
            if used:
                return (made, by_key, at), (request_id, used[0], bool(used[1]), False)
        made = f"job-{request_id}"
        if own is not None:
            by_key[own] = made
        return (made, by_key, at), (request_id, made, False, True)

    def until(self, value):
        return value[2] // 1000 + self.keep_seconds * 1000


def dedupe_requests_stream(requests: DataFrame, jobs: DataFrame, late: str = "10 minutes", keep_seconds: int = 86_400) -> DataFrame:
    """J6 on a stream: requests (request_id, repo_id, commit_sha, idempotency_key, force, ts) in any order within `late`, jobs a static table of those that were there before.

    The jobs that requests make are kept for a commit until keep_seconds of event time after its last request; by then they should be among `jobs`.
    """
    asked = known_jobs(_timed(requests, late), jobs)
    schema = "request_id long, job_id string, cache_hit boolean, created boolean"
    return asked.groupBy("repo_id", "commit_sha").transformWithStateInPandas(_Requests(keep_seconds), schema, "append", "eventTime")


def summary_stream(samples: DataFrame, store: SnapshotStore, name: str, summarise: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """E1, E3 on a stream: each micro-batch is summarised, and merged into the stored table `name`, of which only touched buckets are rewritten.

    For histograms and sketches (merge_histograms, merge_sketches) the table is that of all samples so far. A batch that is run again counts once.
    """

    def handle(rows: DataFrame, number: int) -> None:
        batch = Batch(rows.sparkSession, store, checkpoint, number)
        if not batch.done:
            new = durable(summarise(rows), "summary")
            batch.merge(name, new, merged)
            batch.commit()
            discard(new)

    return samples.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def client_rollup_stream(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """E12 on a stream: windows close with the watermark."""
    return client_event_rollup(events.withWatermark("ts", late), width)


#: Tables of J11's store and the keys of their buckets. What has no key is appended to.
CORPUS_TABLES = {
    "chunks": StoredTable("chunk_id string, repo_id string, file_path string, start_line int, end_line int, language string, content string, vector_id string", "repo_id"),
    "vectors": StoredTable("repo_id string, chunk_id string, content_hash string, file_path string, start_line int, end_line int, language string, embedding array<float>", "repo_id"),
    "cache": StoredTable("model string, content_hash string, embedding array<float>, stored_at timestamp", "content_hash"),
    "results": StoredTable("job_id string, repo_id string, quality_score long, summary string, created_at timestamp", "job_id"),
    "jobs": StoredTable("job_id string, repo_id string, status string, progress int, error_message string, retry_count long, next_retry_at timestamp, completed_at timestamp", "job_id"),
    "progress": StoredTable("job_id string, step int, status string, progress int"),
    "dead_letters": StoredTable("job_id string, repo_id string, stage string, error_code string, error_message string, attempt_count long"),
}


@dataclass
class CorpusStore:
    """Where J11 keeps its tables (CORPUS_TABLES), and its limits."""

    folder: str
    model: str = "hashed"
    dim: int = 64
    max_files: int = 8_000
    max_chunks: int = 20_000
    embed_batch: int = 32
    buckets: int = 32

    @property
    def tables(self) -> SnapshotStore:
        return SnapshotStore(self.folder, CORPUS_TABLES, self.buckets)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return self.tables.read(spark, name)


def job_steps(jobs: DataFrame, embed_batch: int) -> DataFrame:
    """The states that a job goes through (job_id, step, status, progress). jobs: job_id, chunks (null where parsing failed), failed_in.

    They are fixed values: parsing at 10, 30 and 80 percent, embedding from 40 to 95 by batches of chunks, analyzing at 10 and 80, done.
    """
    at = lambda status, *progress: [F.struct(F.lit(status).alias("status"), F.lit(p).cast("int").alias("progress")) for p in progress]
    chunks = F.coalesce("chunks", F.lit(0)).cast("long")
    batches = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(chunks / embed_batch))), lambda i: F.struct(F.lit("embedding").alias("status"), F.least(F.lit(95), 40 + F.floor(F.least(i * embed_batch, chunks) * 50 / F.greatest(chunks, F.lit(1)))).cast("int").alias("progress")))
    parsing = F.array(*at("parsing", 10, 30))
    parsed = F.concat(parsing, F.array(*at("parsing", 80), *at("embedding", 100, 10)))
    embedded = F.concat(parsed, F.array(*at("embedding", 40)), batches)
    ready = F.concat(embedded, F.array(*at("analyzing", 100, 10)))
    failed = F.col("failed_in")
    steps = F.when(failed == "parsing", parsing).when(failed == "embedding", F.when(chunks == 0, parsed).otherwise(embedded)).when(failed == "analyzing", ready).otherwise(F.concat(ready, F.array(*at("analyzing", 80), *at("done", 100))))
    return jobs.select("job_id", F.posexplode(steps).alias("step", "s")).select("job_id", "step", "s.status", "s.progress")


def run_corpus_job(files: DataFrame, repositories: DataFrame, store: CorpusStore, now: Column, source: str = "job", number: int = 0) -> bool:
    """J11 for one set of files (job_id, repo_id, file_path, content, retry_count): S2, S3, C4, S4; V2, V3, V4; A10, S5; rejects go through J5.

    All tables of the store change at once, when the batch `number` of `source` is committed; False if the store holds it already.
    A repository's chunks and vectors are replaced; results, jobs and the cache of vectors are merged by key; states and dead letters are appended.
    Parsing rejects repositories over a limit, embedding those without chunks and vectors that don't fit, analyzing what A10 refuses.
    """
    spark = files.sparkSession
    batch = Batch(spark, store.tables, source, number)
    if batch.done:
        return False
    made = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        made.append(durable(df, label))
        return made[-1]

    files = keep(files, "job-files")
    jobs = keep(files.groupBy("repo_id").agg(F.max("job_id").alias("job_id"), F.max("retry_count").cast("long").alias("retry_count")), "jobs")
    kept = filter_source_files(files)
    few = capacity_guard(kept, store.max_files, "FILE_LIMIT_EXCEEDED")
    cut = keep(chunk_files(within_capacity(kept, few)), "job-chunks")
    many = capacity_guard(cut, store.max_chunks, "CHUNK_LIMIT_EXCEEDED")
    refused = keep(few.unionByName(many).where("error_code is not null").select("repo_id", "error_code"), "job-refused")
    parsed = jobs.join(refused.select("repo_id"), "repo_id", "left_anti")
    chunks = cut.join(refused.select("repo_id"), "repo_id", "left_anti")
    found, fresh = embed_with_cache(chunks, batch.read("cache"), store.model, now, lambda t: embed_hashed(t, store.dim))
    vectors = keep(found.select("repo_id", "chunk_id", "content_hash", "embedding"), "job-vectors")
    unfit = chunks.select("repo_id", "chunk_id").join(check_vectors(chunks, vectors, store.dim), "chunk_id").groupBy("repo_id").agg(F.min("error_code").alias("error_code"))
    sizes = keep(parsed.join(chunks.groupBy("repo_id").agg(F.count("*").alias("chunks")), "repo_id", "left").select("repo_id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks")), "job-sizes")
    bad = keep(unfit.unionByName(sizes.where("chunks = 0").select("repo_id", F.lit("NO_CHUNKS").alias("error_code"))), "job-unfit")
    linked = chunks.join(bad.select("repo_id"), "repo_id", "left_anti").withColumn("vector_id", F.col("chunk_id"))
    payload = vectors.join(linked.select("repo_id", "chunk_id", "file_path", "start_line", "end_line", "language"), ["repo_id", "chunk_id"])
    batch.merge("chunks", linked, lambda old, new: replaced(old, new, "repo_id", parsed), parsed)
    batch.merge("vectors", payload, lambda old, new: replaced(old, new, "repo_id", parsed), parsed)
    batch.merge("cache", fresh, lambda old, new: latest(old, new, "content_hash", "stored_at", "model"))
    embedded = parsed.join(bad.select("repo_id"), "repo_id", "left_anti")
    analysed = keep(analyze_repos(linked, repositories.join(embedded.select("repo_id"), "repo_id", "left_semi")), "job-results")
    done = analysed.where("error_code is null").join(jobs, "repo_id").select("job_id", "repo_id", "quality_score", "summary", now.alias("created_at"))
    batch.merge("results", done, upsert_analysis)
    late = analysed.where("error_code is not null").select("repo_id", "error_code")
    failures = [of.select("repo_id", "error_code", F.lit(stage).alias("stage")) for of, stage in ((refused, "parsing"), (bad, "embedding"), (late, "analyzing"))]
    failed = keep(failures[0].unionByName(failures[1]).unionByName(failures[2]).groupBy("repo_id").agg(F.min_by(F.struct("stage", "error_code"), F.struct("stage", "error_code")).alias("f")).join(jobs, "repo_id").select("repo_id", "job_id", "retry_count", "f.stage", "f.error_code", F.lit("rejected").alias("message")), "job-failures")
    sent_back = route_failures(failed, now).join(failed.select("job_id", "repo_id"), "job_id").drop("dead_letter")
    ended = jobs.join(analysed.where("error_code is null").select("repo_id"), "repo_id").select("job_id", "repo_id", F.lit("done").alias("status"), F.lit(100).alias("progress"), "retry_count", now.alias("completed_at"))
    batch.merge("jobs", sent_back.unionByName(ended, allowMissingColumns=True), lambda old, new: replaced(old, new, "job_id", new))
    told = jobs.join(sizes, "repo_id", "left").join(failed.select("job_id", F.col("stage").alias("failed_in")), "job_id", "left")
    batch.append("progress", job_steps(told, store.embed_batch))
    batch.append("dead_letters", dead_letters(failed))
    batch.commit()
    discard(*made)
    return True


def corpus_job(file_sets: DataFrame, repositories: DataFrame, store: CorpusStore, checkpoint: str) -> StreamingQuery:
    """Every new set of files goes through run_corpus_job as one batch, named by the checkpoint and the stream's number, so a batch that is run again changes nothing twice."""
    handle = lambda batch, number: run_corpus_job(batch, repositories, store, F.current_timestamp(), checkpoint, number)
    return file_sets.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
