"""Job-state tables (J1-J12): newest job, events, changes, due work, failures, duplicates, limits, validity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.sources.tables import newest

ACTIVE = ("queued", "parsing", "embedding", "analyzing")
STAGES = {"parse": ("queued", "parsing"), "embed": ("embedding",), "analyze": ("analyzing",)}


def latest_job(jobs: DataFrame) -> DataFrame:
    """J1"""
    return newest(jobs, ["repo_id"], "created_at", "job_id")


def status_events(jobs: DataFrame) -> DataFrame:
    """The event that a job's state stands for."""
    message = F.coalesce("error_message", F.lit(""))
    parts = F.split(message, ":", 2)
    failed, done = F.col("status") == "failed", F.col("status") == "done"
    code = F.when(failed, F.when(F.size(parts) > 1, F.trim(parts[0])).otherwise("UNKNOWN"))
    text = F.when(failed, F.when(F.size(parts) > 1, F.trim(F.get(parts, F.lit(1)))).otherwise(message)).when(done, "done").otherwise(F.concat("status", F.lit(" in progress")))
    return jobs.select("job_id", F.when(failed, "error").when(done, "done").otherwise("progress").alias("event"), code.alias("code"), text.alias("message"), F.when(done, 100).when(failed, F.coalesce(F.nullif("progress", F.lit(0)), F.lit(100))).otherwise(F.col("progress")).cast("int").alias("progress"))


def status_changes(history: DataFrame) -> DataFrame:
    """J3, batch twin: states that differ from the one before, up to the first terminal state of the job."""
    ordered = Window.partitionBy("job_id").orderBy("ts", "event_id")
    mark = F.concat_ws("|", "status", F.col("progress").cast("string"), F.coalesce("error_message", F.lit("")))
    ended = F.max(F.col("status").isin("done", "failed").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("mark", mark).withColumn("was", F.lag("mark").over(ordered)).withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0 and (was is null or was != mark)").select("job_id", "event_id", "status", "progress")


def due_jobs(jobs: DataFrame, repositories: DataFrame, now: Column, most: int = 1) -> DataFrame:
    """The oldest jobs of each stage that may run now."""
    stage = F.lit(None).cast("string")
    for name, statuses in STAGES.items():
        stage = F.when(F.col("status").isin(*statuses), name).otherwise(stage)
    ready = jobs.withColumn("stage", stage).where(F.col("stage").isNotNull() & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))).join(repositories.select("repo_id"), "repo_id")
    nth = F.row_number().over(Window.partitionBy("stage").orderBy("created_at", "job_id"))
    return ready.withColumn("nth", nth).where(F.col("nth") <= most).select("stage", "nth", "job_id", "repo_id")


def is_retriable(stage: Column, code: Column) -> Column:
    return code.endswith("TIMEOUT") | ((stage == "embedding") & (code == "EMBED_UPSERT_FAILED")) | ((stage == "parsing") & code.isin("CLONE_FAILED", "CLONE_TIMEOUT")) | code.startswith("UNEXPECTED_")


def route_failures(failures: DataFrame, now: Column, most_retries: int = 3, base_seconds: int = 30) -> DataFrame:
    """Retriable failures go back to their stage with exponential delay, others fail for good (see dead_letters). progress is null where it stays."""
    again = is_retriable(F.col("stage"), F.col("error_code")) & (F.col("retry_count") < most_retries)
    delay = F.make_interval(secs=(base_seconds * F.pow(F.lit(2), "retry_count")).cast("decimal(18,6)"))
    message = F.concat("error_code", F.lit(": "), "message")
    return failures.select(
        "job_id", F.when(again, F.col("stage")).otherwise("failed").alias("status"), F.when(~again, 100).alias("progress"), message.alias("error_message"), (F.col("retry_count") + F.when(again, 1).otherwise(0)).cast("long").alias("retry_count"),
        F.when(again, now + delay).alias("next_retry_at"), F.when(~again, now).alias("completed_at"), (~again).alias("dead_letter"),
    )


def dead_letters(failures: DataFrame, most_retries: int = 3) -> DataFrame:
    """The rows of failures that are not tried again, with the attempts made."""
    again = is_retriable(F.col("stage"), F.col("error_code")) & (F.col("retry_count") < most_retries)
    return failures.where(~again).select("job_id", "repo_id", "stage", "error_code", F.col("message").alias("error_message"), F.col("retry_count").cast("long").alias("attempt_count"))


def known_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests with what jobs hold for them: `keyed`, the newest job of their repository, commit and key, and `live`, the newest active or done one of their commit; both (job_id, done)."""
    found = F.max_by(F.struct("job_id", (F.col("status") == "done").alias("done")), F.struct("created_at", "job_id"))
    keyed = jobs.groupBy("repo_id", "commit_sha", "idempotency_key").agg(found.alias("keyed"))
    live = jobs.where(F.col("status").isin(*ACTIVE, "done")).groupBy("repo_id", "commit_sha").agg(found.alias("live"))
    asked = requests.withColumn("idempotency_key", F.nullif("idempotency_key", F.lit("")))
    return asked.join(keyed, ["repo_id", "commit_sha", "idempotency_key"], "left").join(live, ["repo_id", "commit_sha"], "left")


def dedupe_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """The job that each request (request_id, repo_id, commit_sha, idempotency_key, force, ts) gets, in the order of ts and request_id; (request_id, job_id, cache_hit, created).

    A forced request makes a job, named by it. Any other takes the newest job of its own key, made before or by a request before it, else the newest
    active or done one of its commit; only the first of a commit that finds neither makes one, which those after it take.
    """
    order = ["ts", "request_id"]
    commit, key = (Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for by in (["repo_id", "commit_sha"], ["repo_id", "commit_sha", "idempotency_key"]))
    asked = known_jobs(requests, jobs).withColumn("force", F.coalesce("force", F.lit(False)))
    may_make = F.col("force") | (F.col("keyed").isNull() & F.col("live").isNull())
    asked = asked.withColumn("may_make", may_make).withColumn("created", F.col("force") | (F.col("may_make") & (F.coalesce(F.count_if("may_make").over(commit), F.lit(0)) == 0)))
    own = F.when(F.col("created"), F.struct(F.concat(F.lit("job-"), F.col("request_id").cast("string")).alias("job_id"), F.lit(False).alias("done")))
    asked = asked.withColumn("own", own).withColumn("by_key", F.when(F.col("idempotency_key").isNotNull(), F.last("own", True).over(key))).withColumn("by_commit", F.last("own", True).over(commit))
    job = F.coalesce("own", "by_key", "keyed", "by_commit", "live")
    return asked.select("request_id", job["job_id"].alias("job_id"), job["done"].alias("cache_hit"), "created")


#: Requests of a window that an identity of each type may make: fixed values.
LIMITS = {"auth": 50, "guest": 10}


def rate_limit_audit(requests: DataFrame, limits: dict[str, int] | None = None, seconds: int = 3600) -> DataFrame:
    """J7, batch twin: requests (scope, identity_type, identity, request_id, ts) against the limit of their type, that of guests for any other type than those of `limits`.

    Windows start at the first request of an identity. Spark sorts each identity's requests; the fold keeps (identity, start, count) across Arrow
    batches, as the streaming form does as state, so time is linear and memory a batch, however many requests an identity has.
    """
    own = ["scope", "identity_type", "identity"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, n = None, None, 0
        for b in batches:
            nth = []
            for *who, at in zip(*[b[c].to_pylist() for c in (*own, "at")]):
                if who != last:
                    last, start, n = who, None, 0
                if start is None or at >= start + seconds * 1_000_000:
                    start, n = at, 0
                n += 1
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in (*own, "request_id", "most")], pa.array(nth, pa.int64())], [*own, "request_id", "most", "nth"])

    most = limit_of(F.col("identity_type"), limits or LIMITS)
    timed = requests.select(*own, F.col("request_id").cast("long").alias("request_id"), most.alias("most"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    types = dict(timed.dtypes)
    ordered = timed.repartition(*own).sortWithinPartitions(*own, "at", "request_id")
    counted = ordered.mapInArrow(fold, ", ".join(f"{c} {types[c]}" for c in own) + ", request_id long, most int, nth long")
    return counted.select(*own, "request_id", (F.col("nth") <= F.col("most")).alias("allowed"), F.greatest(F.col("most") - F.col("nth"), F.lit(0)).cast("int").alias("remaining"))


def limit_of(identity_type: Column, limits: dict[str, int]) -> Column:
    """The limit of a type of identity."""
    found = F.lit(limits["guest"])
    for name, most in limits.items():
        found = F.when(identity_type == name, most).otherwise(found)
    return found.cast("int")


def stage_progress(batches: DataFrame, total: str = "total") -> DataFrame:
    """Progress after each batch of an embedding job."""
    upto = Window.partitionBy("job_id").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.sum("n").over(upto)
    return batches.select("job_id", "batch_no", F.least(F.lit(95), 40 + F.floor(done * 50 / F.col(total))).cast("int").alias("progress"))


def dashboard(repositories: DataFrame, results: DataFrame) -> DataFrame:
    """J9"""
    last = newest(results, ["repo_id"], "created_at", "job_id").select("repo_id", F.struct("job_id", "quality_score").alias("analysis"))
    out = repositories.join(last, "repo_id", "left")
    return out.select("repo_id", F.col("analysis").isNotNull().alias("has_analysis"), F.col("analysis.job_id").alias("job_id"), F.col("analysis.quality_score").alias("quality_score"))


def complete_jobs(jobs: DataFrame, finished: DataFrame, now: Column) -> DataFrame:
    """Jobs with the finished ones done."""
    out = jobs.join(finished.select("job_id", F.lit(True).alias("f")), "job_id", "left")
    return out.select("job_id", "repo_id", F.when(F.col("f"), "done").otherwise(F.col("status")).alias("status"), F.when(F.col("f"), 100).otherwise(F.col("progress")).cast("int").alias("progress"), F.when(F.col("f"), None).otherwise(F.col("error_message")).alias("error_message"), F.when(F.col("f"), now).alias("completed_at"))


def mark_analyzed(repositories: DataFrame, jobs: DataFrame, finished: DataFrame, now: Column) -> DataFrame:
    """Repositories (repo_id, last_analyzed_at) of finished jobs get the same instant as those jobs."""
    done = jobs.join(finished.select("job_id"), "job_id", "left_semi").select("repo_id").distinct().withColumn("f", F.lit(True))
    return repositories.join(done, "repo_id", "left").withColumn("last_analyzed_at", F.when(F.col("f"), now).otherwise(F.col("last_analyzed_at"))).drop("f")


def valid_tokens(tokens: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Whether a share token that is asked for (share_id, repo_id) can be used, or why not."""
    known = tokens.select("share_id", F.col("repo_id").alias("own"), "revoked_at", "expires_at")
    out = asked.join(known, "share_id", "left")
    invalid = ~F.coalesce(F.col("own") == F.col("repo_id"), F.lit(False))
    state = F.when(invalid, "invalid").when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") <= now, "expired").otherwise("valid")
    return out.select("share_id", "repo_id", state.alias("state"))


def share_expiry(ttl_days: Column, now: Column, default: int = 7) -> Column:
    """When a new share token expires; null if its days are not from 1 to 30."""
    days = F.coalesce(ttl_days, F.lit(default))
    return F.when(days.between(1, 30), now + F.make_interval(days=days))
