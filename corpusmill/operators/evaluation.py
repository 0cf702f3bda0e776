"""Telemetry and evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import stripped
from corpusmill.sources.tables import durable

BUCKETS = (1, 5, 10, 30, 60, 120, 300)
METRICS = ("relevance", "correctness", "precision", "recall")


def duration_histogram(samples: DataFrame, labels: list[str], value: str, buckets: tuple[int, ...] = BUCKETS) -> DataFrame:
    """Cumulative buckets, count and sum; negative values count as 0."""
    v = F.greatest(F.col(value), F.lit(0.0))
    return samples.groupBy(*labels).agg(*[F.count_if(v <= b).alias(f"le_{b}") for b in buckets], F.count(value).alias("n"), F.bround(F.sum(v), 4).alias("total"))


def label_counters(samples: DataFrame, labels: list[str], empty: str = "unknown") -> DataFrame:
    """E2"""
    named = [F.lower(F.when(F.coalesce(F.trim(c), F.lit("")) == "", empty).otherwise(F.col(c))).alias(c) for c in labels]
    return samples.groupBy(*named).agg(F.count("*").alias("n"))


def merge_histograms(old: DataFrame, new: DataFrame, labels: list[str]) -> DataFrame:
    """E1 of both: sums of two tables of duration_histogram."""
    sums = [c for c in new.columns if c not in labels]
    return old.select(*new.columns).unionByName(new).groupBy(*labels).agg(*[F.sum(c).alias(c) for c in sums])


def percentile_sketches(rows: DataFrame, value: str, by: list[str], k: int = 800) -> DataFrame:
    """E3 in bounded space: (by..., sketch), a KLL sketch of each group's values, nulls left out. With k of 800 ranks are off by less than 0.5 % of the values, with 99 % confidence."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merge_sketches(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of both tables; the order of merges doesn't matter to the error."""
    return old.select(*new.columns).unionByName(new).groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_percentiles(sketches: DataFrame, percents: tuple[float, ...], by: list[str]) -> DataFrame:
    """E3 from sketches: (by..., percent, value, n)."""
    found = F.arrays_zip(F.array(*[F.lit(float(p)) for p in percents]).alias("percent"), F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p / 100) for p in percents])).alias("value"))
    each = sketches.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), F.explode(found).alias("x"))
    return each.select(*by, "x.percent", "x.value", "n")


def nearest_rank(rows: DataFrame, value: str, percents: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., percent, value): sorted[ceil(p/100 n) - 1] of each group, nulls left out; a group without values has no row.

    Counts by value are sorted by ranges; a rank is looked up in the one range that holds it, so no task buffers a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    placed = durable(counts.repartitionByRange(*by, "value").withColumn("part", F.spark_partition_id()), "ranges")
    group = Window.partitionBy(*by, F.lit(0))
    parts = placed.groupBy(*by, "part").agg(F.sum("n").alias("n"))
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(group))
    asked = parts.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents]))).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("total") / 100)))
    asked = asked.where("start < rank and rank <= start + n").drop("n", "total")
    within = Window.partitionBy(*by, "part", "percent").orderBy("value")
    found = placed.join(asked, [*by, "part"]).withColumn("upto", F.col("start") + F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return found.where("upto >= rank and upto - n < rank").select(*by, "percent", "value")


def sla_report(runs: DataFrame, analysis_target: float = 180, token_target: float = 1000) -> DataFrame:
    """p50 and p95 of analysis seconds of done runs, and of first-token times, against their targets."""
    seconds = nearest_rank(runs.where("status = 'done'"), "seconds", (50, 95)).withColumn("what", F.lit("analysis"))
    both = seconds.unionByName(nearest_rank(runs, "token_ms", (50, 95)).withColumn("what", F.lit("token")))
    t = both.agg(*[F.max(F.when((F.col("what") == what) & (F.col("percent") == p), F.col("value"))).alias(f"{what}_p{p}") for what in ("analysis", "token") for p in (50, 95)])
    return t.select("*", (F.col("analysis_p95") < analysis_target).alias("analysis_ok"), (F.col("token_p95") < token_target).alias("token_ok"))


def latency_ok_avg(results: DataFrame) -> DataFrame:
    """E5"""
    ok = F.when(F.col("status") == "ok", F.col("latency_ms"))
    return results.groupBy("run_type").agg(F.coalesce(F.bround(F.avg(ok), 3), F.lit(0.0)).alias("latency_ms"), F.count(ok).alias("n"))


def scorecard_metrics(scores: DataFrame, results: DataFrame) -> DataFrame:
    """By run: means of the scores, precision among cited answers, recall over all scored."""
    last = results.groupBy("run_type", "repo_key", "question_id").agg(F.max_by("no_citation", "result_no").alias("no_citation"))
    t = scores.where("repo_key is not null and question_id is not null").join(last, ["run_type", "repo_key", "question_id"], "left")
    cited = F.coalesce(~F.col("no_citation"), F.lit(False))
    good = F.count_if(cited & (F.col("correctness") >= 2))
    return t.groupBy("run_type").agg(F.bround(F.avg("relevance"), 3).alias("relevance"), F.bround(F.avg("correctness"), 3).alias("correctness"), F.coalesce(F.bround(good / F.nullif(F.count_if(cited), F.lit(0)), 3), F.lit(0.0)).alias("precision"), F.coalesce(F.bround(good / F.nullif(F.count("*"), F.lit(0)), 3), F.lit(0.0)).alias("recall"))


def run_delta(metrics: DataFrame) -> DataFrame:
    """Candidate less baseline for each metric."""
    long = metrics.unpivot(["run_type"], list(METRICS), "metric", "value")
    t = long.groupBy("metric").agg(F.max(F.when(F.col("run_type") == "baseline", F.col("value"))).alias("baseline"), F.max(F.when(F.col("run_type") == "candidate", F.col("value"))).alias("candidate"))
    return t.select("metric", "baseline", "candidate", F.bround(F.col("candidate") - F.col("baseline"), 3).alias("delta"))


#: Labels of a summary's sections, and phrases of its noise.
SECTIONS = ("Purpose", "Core modules", "Runtime flow", "Output formats", "Primary languages")
NOISE = ("parse/index stage identified", "representative paths include")
#: The start of a bullet that has some text; lines end at a line feed alone.
BULLET = r"(?dm)^\s*[-*] [^\S\r\n]*\S"


def has_section(text: Column, label: str) -> Column:
    """Whether a bullet of the text has that label, plain or bold, before a colon."""
    return text.rlike(rf"(?idm)^\s*[-*]\s*(?:{label}|\*\*{label}\*\*)\s*:")


def chat_quality(answers: DataFrame) -> DataFrame:
    """Score and flags of each answer; passed from 3 points on without flags."""
    text = stripped(F.col("answer"))
    blank, bare = text == "", F.coalesce(F.col("citation_count") <= 0, F.lit(True))
    summary = F.lower(F.coalesce("intent", F.lit("general"))) == "summary"
    shaped = F.regexp_count(text, F.lit(BULLET)) >= 4
    for label in SECTIONS:
        shaped = shaped & has_section(text, label)
    noisy = text.rlike("(?i)" + "|".join(NOISE))
    short = F.length(text) < 40
    one = lambda cond: F.when(cond, 1).otherwise(0)
    score = one(~blank) + one(~bare) + F.when(summary, 2 * one(shaped) + one(~noisy)).otherwise(one(~short))
    named = {"empty_answer": blank, "missing_citations": bare, "summary_structure_incomplete": summary & ~shaped, "summary_noise_phrase": summary & noisy, "answer_too_short": ~summary & short}
    flags = F.array_compact(F.array(*[F.when(cond, name) for name, cond in named.items()]))
    return answers.select("answer_id", score.alias("score"), F.array_join(flags, ",").alias("flags"), ((score >= 3) & (F.size(flags) == 0)).alias("passed"))


def chat_quality_rollup(rows: DataFrame) -> DataFrame:
    """E9"""
    ok = F.col("status") == "ok"
    n = F.nullif(F.count_if(ok), F.lit(0))
    share = lambda cond: F.coalesce(F.bround(100.0 * F.count_if(ok & cond) / n, 2), F.lit(0.0))
    return rows.agg(F.count("*").alias("rows"), share(F.col("passed")).alias("pass_rate"), share(F.col("citation_count") > 0).alias("coverage"), F.coalesce(F.bround(F.avg(F.when(ok, F.col("latency_ms"))), 2), F.lit(0.0)).alias("latency_ms"), F.count_if(~ok | ~F.col("passed")).alias("failed"))


def rubric_gate(scores: DataFrame) -> DataFrame:
    """Rows pass from 7 of 10 on; a run passes with a mean of 7.5 and no row under 5; errors count as 0."""
    total = F.when(F.col("status") == "ok", F.col("relevance") + F.col("correctness") + F.col("coverage") + F.col("clarity")).otherwise(0)
    t = scores.groupBy("run_type").agg(F.bround(F.avg(total), 3).alias("mean"), F.min(total).cast("long").alias("least"), F.count_if(total >= 7).alias("rows_passed"), F.count("*").alias("rows"))
    return t.withColumn("passed", (F.col("mean") >= 7.5) & (F.col("least") >= 5))


def recall_at_k(results: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Share of the questions with a relevant item among the first k."""
    hits = results.where(F.col("rank") <= k).join(relevant, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    return relevant.select("query_id").distinct().join(hits, "query_id", "left").agg(F.count("*").alias("questions"), F.bround(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def client_event_rollup(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Count and mean duration by window, event and route; the same expression serves a stream with a watermark."""
    return events.groupBy(F.window("ts", width).alias("w"), "event", "route").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean")).select(F.col("w.start").alias("start"), "event", "route", "n", F.bround("mean", 4).alias("mean_ms"))
