"""Commit diffs (D1-D7): records and hunks by windows over a table of diff lines; security labels; summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import LINE_BREAK, ascii_words
from corpusmill.operators.graph import blast_radius

#: Labels of security-sensitive text and their patterns.
SECURITY_PATTERNS = {
    "auth": r"\bauth(?:enticat|oriz)?", "token": r"\btokens?\b", "jwt": r"\bjwt\b", "oauth": r"\boauth\b", "password": r"\bpass(?:word|wd)\b", "secret": r"\bsecret\b", "credential": r"\bcredential",
    "api_key": r"\bapi[_-]?key\b", "env": r"\.env\b|\bENV\[|os\.environ", "crypto": r"\b(?:encrypt|decrypt|hash|hmac|bcrypt|sha256)\b",
}
#: What a lower text must hold, one of each, before a pattern is tried.
SECURITY_STEMS = {
    "auth": ("auth",), "token": ("token",), "jwt": ("jwt",), "oauth": ("oauth",), "password": ("pass",), "secret": ("secret",), "credential": ("credential",),
    "api_key": ("key",), "env": ("env",), "crypto": ("crypt", "hash", "hmac", "sha256"),
}
HEADER = r"^diff --git a/(.+?) b/(.+)$"
_START = r"(?dm)(?=^diff --git a/.+? b/.+$)"
_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def diff_files(diffs: DataFrame, most_lines: int = 200) -> DataFrame:
    """One record for each file of a diff, with its hunks and first added lines. All in the row: no shuffle. Every line break ends a line, as in P2."""
    parts = F.filter(F.split(F.regexp_replace("diff_text", LINE_BREAK, "\n"), _START), lambda p: p.startswith("diff --git a/") & p.rlike("(?dm)" + HEADER))
    files = diffs.select("repo_id", "head_sha", F.posexplode(parts).alias("nth", "part")).select("repo_id", "head_sha", F.col("nth") + 1, F.split("part", "\n").alias("lines")).toDF("repo_id", "head_sha", "file_no", "lines")
    header = F.get("lines", F.lit(0))
    renamed = F.try_element_at(F.filter("lines", lambda x: x.startswith("+++ b/")), F.lit(-1))
    status = lambda x: F.when(x.startswith("new file mode"), "added").when(x.startswith("deleted file mode"), "deleted").when(x.startswith("rename from") | x.startswith("rename to"), "renamed")
    plus = F.filter("lines", lambda x: x.startswith("+") & ~x.startswith("+++"))
    minus = F.filter("lines", lambda x: x.startswith("-") & ~x.startswith("---"))
    start = lambda x: F.regexp_extract(x, _HUNK, 1).try_cast("int")
    count = lambda x: F.coalesce(F.regexp_extract(x, _HUNK, 2).try_cast("int"), F.lit(1))
    hunks = F.transform(F.filter("lines", lambda x: x.startswith("@@ ") & start(x).isNotNull()), lambda x: F.struct(start(x).alias("start"), (start(x) + F.greatest(count(x), F.lit(1)) - 1).alias("end")))
    return files.select(
        "repo_id", "head_sha", F.col("file_no").cast("long").alias("file_no"), F.coalesce(F.substring(renamed, 7, 1 << 30), F.regexp_extract(header, HEADER, 2)).alias("path"), F.regexp_extract(header, HEADER, 1).alias("old_path"),
        F.coalesce(F.try_element_at(F.array_compact(F.transform("lines", status)), F.lit(-1)), F.lit("modified")).alias("status"), F.size(plus).cast("long").alias("added"), F.size(minus).cast("long").alias("removed"),
        hunks.alias("hunks"), F.transform(F.slice(plus, 1, most_lines), lambda x: F.substring(x, 2, 1 << 30)).alias("added_lines"),
    )


def security_touches(files: DataFrame) -> DataFrame:
    """D3: sorted labels of what a file's path and added lines mention; files without a label are left out.

    The text is bound once, and the labels come out of a generator, below which no filter is pushed: each pattern occurs once in the plan.
    """
    text = F.concat_ws("\n", F.array(F.col("path")), F.col("added_lines"))
    holds = lambda low, name: reduce(lambda a, b: a | b, [low.contains(stem) for stem in SECURITY_STEMS[name]])
    found = lambda x: F.array_sort(F.array_compact(F.array(*[F.when(holds(x["low"], name) & x["t"].rlike("(?i)" + ascii_words(p)), F.lit(name)) for name, p in SECURITY_PATTERNS.items()])))
    lowered = F.transform(F.array(text), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    labels = F.filter(F.transform(lowered, found), lambda c: F.size(c) > 0)
    return files.select("repo_id", "head_sha", "path", F.explode(labels).alias("categories"))


def diff_summary(files: DataFrame) -> DataFrame:
    """D4"""
    return files.select("repo_id", "head_sha", "path", "status", "added", "removed", F.size("hunks").alias("hunks"))


def diff_contexts(files: DataFrame, most: int = 6, lines: int = 60) -> DataFrame:
    """The first files of a diff with the span of their hunks and the start of what they add."""
    nth = F.row_number().over(Window.partitionBy("repo_id", "head_sha").orderBy("file_no"))
    return files.withColumn("rank", nth).where(F.col("rank") <= most).select("repo_id", "head_sha", "rank", "path", F.try_element_at("hunks", F.lit(1))["start"].alias("line_start"), F.try_element_at("hunks", F.lit(-1))["end"].alias("line_end"), F.array_join(F.slice("added_lines", 1, lines), "\n").alias("content"))


def commit_report(files: DataFrame, edges: DataFrame) -> DataFrame:
    """For each diff, how many files changed, which are sensitive and how many other files import what it changed."""
    changed = files.groupBy("repo_id", "head_sha").agg(F.count("*").alias("changed"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    flagged = security_touches(files).groupBy("repo_id", "head_sha").agg(F.count("*").alias("flagged"))
    own = files.where("coalesce(path, '') != ''").select("repo_id", "head_sha", F.col("path").alias("file_path"))
    reach = blast_radius(edges, own).groupBy("repo_id", "head_sha").agg(F.count("*").alias("impacted"))
    out = changed.join(flagged, ["repo_id", "head_sha"], "left").join(reach, ["repo_id", "head_sha"], "left")
    return out.select("repo_id", "head_sha", "changed", "added", "removed", F.coalesce("flagged", F.lit(0)).cast("long").alias("flagged"), F.coalesce("impacted", F.lit(0)).cast("long").alias("impacted"))


def diff_fallback_answer(diffs: DataFrame, files: DataFrame) -> DataFrame:
    """Sorted categories of a diff, and the sentence that stands in for a model's answer. The sentence is a fixed value."""
    keys = ["repo_id", "head_sha"]
    names = security_touches(files).select(*keys, F.explode("categories").alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_set("c")).alias("categories"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("file_no"))
    first = files.withColumn("n", nth).where("n <= 8").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "path"))).alias("p"))
    out = diffs.select(*keys).distinct().join(first, keys, "left").join(names, keys, "left")
    some = F.coalesce(F.array_join("categories", ", "), F.lit(""))
    touched = F.coalesce(F.nullif(F.array_join(F.transform("p", lambda x: x["path"]), ", "), F.lit("")), F.lit("no files"))
    note = F.when(some != "", F.concat(F.lit(" Security-sensitive areas: "), some, F.lit("."))).otherwise("")
    text = F.concat(F.lit("This commit ("), F.substring("head_sha", 1, 10), F.lit(") changed: "), touched, F.lit("."), note)
    return out.select(*keys, some.alias("categories"), text.alias("answer"))
