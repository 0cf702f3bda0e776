"""Per-repository quality statistics over chunks (A1-A10). One row for each repository, path or language, never a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import is_test_path, normalize_language, stripped
from corpusmill.sources.tables import durable

TODO = r"(?i)(?<![A-Za-z0-9_])(?:TODO|FIXME)(?![A-Za-z0-9_])"


def language_breakdown(chunks: DataFrame) -> DataFrame:
    """A1: characters and share of each language of a repository."""
    lang = F.lower(F.when(F.coalesce("language", F.lit("")) == "", "unknown").otherwise(F.col("language")))
    sized = chunks.groupBy("repo_id", lang.alias("lang")).agg(F.sum(F.length("content")).alias("chars"))
    total = F.greatest(F.sum("chars").over(Window.partitionBy("repo_id")), F.lit(1))
    return sized.select("repo_id", "lang", "chars", F.bround(100.0 * F.col("chars") / total, 2).alias("pct"))


def todo_count(chunks: DataFrame) -> DataFrame:
    """A2"""
    return chunks.groupBy("repo_id").agg(F.sum(F.regexp_count("content", F.lit(TODO))).cast("long").alias("todo"))


def long_chunks(chunks: DataFrame, lines: int = 50, most: int = 50) -> DataFrame:
    """A3: chunks of more than `lines` lines, the first `most` of a repository in the order of path and line."""
    length = F.col("end_line") - F.col("start_line") + 1
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy("file_path", "start_line", "chunk_id"))
    return chunks.where(length > lines).select("repo_id", "file_path", "start_line", length.alias("length"), nth.alias("nth")).where(F.col("nth") <= most)


def missing_tests(chunks: DataFrame, most: int = 20) -> DataFrame:
    """A4: of a repository without any test path, the first paths. Each task keeps its own first ones before the shuffle, so a large repository is no task's."""
    tested = chunks.where(is_test_path(F.col("file_path"))).select("repo_id").distinct()
    paths = chunks.select("repo_id", "file_path").distinct().join(tested, "repo_id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy("file_path"))
    return paths.withColumn("nth", nth).where(F.col("nth") <= most).select("repo_id", "file_path", "nth")


def file_metrics(chunks: DataFrame) -> DataFrame:
    """A5"""
    known = (F.coalesce("start_line", F.lit(0)) != 0) & (F.coalesce("end_line", F.lit(0)) != 0)
    lines = F.when(known, F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)).otherwise(0)
    return chunks.groupBy("repo_id", "file_path").agg(F.count("*").alias("chunks"), F.sum(lines).alias("lines"), F.min_by("language", F.struct("start_line", "chunk_id")).alias("language"))


def path_facts(chunks: DataFrame, lines: int = 50) -> DataFrame:
    """What A6 and A8 need of the chunks of a path in one language: chars, chunks, marks of open work, long chunks. One pass over the contents."""
    lang = F.lower(F.when(F.coalesce("language", F.lit("")) == "", "unknown").otherwise(F.col("language")))
    length = F.col("end_line") - F.col("start_line") + 1
    return chunks.groupBy("repo_id", "file_path", lang.alias("lang")).agg(F.sum(F.length("content")).alias("chars"), F.count("*").alias("chunks"), F.sum(F.regexp_count("content", F.lit(TODO))).alias("todo"), F.count_if(length > lines).alias("long"))


def quality_of(facts: DataFrame, most_long: int = 50) -> DataFrame:
    """A6 from path_facts."""
    t = facts.groupBy("repo_id").agg(F.max(F.lower("file_path").endswith("readme.md")).alias("readme"), F.max(is_test_path(F.col("file_path"))).alias("tested"), F.coalesce(F.sum("todo"), F.lit(0)).alias("todo"), F.least(F.lit(most_long), F.sum("long")).alias("long"))
    score = 100 - F.least(F.lit(30), F.col("todo")) - F.least(F.lit(30), 2 * F.col("long")) - F.when(F.col("tested"), 0).otherwise(20) + F.when(F.col("readme"), 5).otherwise(0)
    return t.select("repo_id", F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("long").alias("quality_score"))


def quality_score(chunks: DataFrame, lines: int = 50) -> DataFrame:
    """100 less debt, between 0 and 100."""
    return quality_of(path_facts(chunks, lines))


def top_contributors(commits: DataFrame, most: int = 10) -> DataFrame:
    """A7"""
    counted = commits.groupBy("repo_id", "author").agg(F.count("*").alias("commits"))
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("commits"), "author"))
    return counted.withColumn("nth", nth).where(F.col("nth") <= most)


def architecture_of(facts: DataFrame, repositories: DataFrame) -> DataFrame:
    """A8 from a stored table of path_facts. The sentences are fixed values."""
    langs = facts.groupBy("repo_id", "lang").agg(F.sum("chars").alias("chars"))
    lang = langs.groupBy("repo_id").agg(F.min_by("lang", F.struct(-F.col("chars"), "lang")).alias("top_language"))
    paths = facts.groupBy("repo_id", "file_path").agg(F.sum("chunks").alias("chunks"))
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy("file_path"))
    first = paths.select("repo_id", "file_path").withColumn("nth", nth).where("nth <= 5").groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ", ").alias("first_paths"))
    out = paths.groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks")).join(lang, "repo_id").join(first, "repo_id").join(repositories.select("repo_id", "full_name", "default_branch"), "repo_id")
    text = F.format_string(
        "Repository %s (branch %s) is primarily %s. The parse/index stage identified %d source files and %d chunks. Representative paths include: %s. "
        "This summary is generated from structural chunk metadata and should be refined with LLM synthesis in later stages.",
        "full_name", "default_branch", "top_language", "files", "chunks", "first_paths",
    )
    return out.select("repo_id", "top_language", "files", "chunks", "first_paths", text.alias("summary"))


def architecture_facts(chunks: DataFrame, repositories: DataFrame) -> DataFrame:
    """Top language, counts, first five paths and the summary made of them; repositories: repo_id, full_name, default_branch."""
    return architecture_of(durable(path_facts(chunks), "path-facts"), repositories)


def _named_hints(found: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in found.items()]))


def repo_summary_facets(results: DataFrame, most: int = 8) -> DataFrame:
    """Of each question, module roots, languages, output hints and flow hints of its first results. Hints are fixed values."""
    name = normalize_language(F.col("language"))
    known = (F.col("rank") <= most) & (F.coalesce("file_path", F.lit("")) != "")
    t = results.groupBy("query_id", "repo_id").agg(F.array_sort(F.collect_list(F.when(known, F.struct("rank", "file_path")))).alias("p"), F.array_sort(F.collect_list(F.when(name.isNotNull(), F.struct("rank", name.alias("name"))))).alias("l"))
    t = t.select("query_id", "repo_id", F.transform("p", lambda x: x["file_path"]).alias("paths"), F.array_distinct(F.transform("l", lambda x: x["name"])).alias("languages"))

    def module(path: Column) -> Column:
        parts = F.filter(F.split(path, "/"), lambda p: p != "")
        root = stripped(F.get(parts, F.lit(0)))
        nested = root.isin("src", "app", "lib", "packages") & (F.size(parts) > 1)
        return F.when(nested, F.concat(root, F.lit("/"), stripped(F.get(parts, F.lit(1))))).otherwise(root)

    low = F.transform("paths", F.lower)
    modules = F.slice(F.array_distinct(F.filter(F.transform("paths", module), lambda m: m != "")), 1, 5)
    first = lambda word: F.array_position(F.transform(low, lambda p: p.contains(word)), F.lit(True))
    media = F.array(*[F.struct(first(word).alias("at"), F.lit(i).alias("nth"), F.lit(label).alias("name")) for i, (word, label) in enumerate((("gif", "GIF"), ("webp", "WebP"), ("dataurl", "data URL")))])
    media = F.transform(F.array_sort(F.filter(media, lambda m: m["at"] > 0)), lambda m: m["name"])
    ends = lambda *suffixes: F.exists(low, lambda p: p.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    holds = lambda *words: F.exists(low, lambda p: p.rlike("|".join(w.replace(".", r"\.") for w in words)))
    views = _named_hints({"web UI views": ends(".html", ".tsx", ".jsx", ".vue", ".svelte"), "structured config/data": ends(".json", ".yaml", ".yml")})
    flows = _named_hints({
        "CLI entrypoint receives arguments": holds("cli", "argparse", "typer"),
        "request handlers call service modules": holds("api", "route", "controller"),
        "UI components render feature views": holds("component", "react", ".tsx$"),
        "core modules execute main business logic": holds("service", "core", "engine"),
    })
    return t.select("query_id", "repo_id", modules.alias("modules"), "languages", F.concat(media, views).alias("outputs"), F.slice(flows, 1, 3).alias("flows"))


def analyze_repos(chunks: DataFrame, repositories: DataFrame) -> DataFrame:
    """A10: one result for each repository; one without chunks fails with NO_CHUNKS. The contents are read once."""
    facts = durable(path_facts(chunks), "path-facts")
    done = quality_of(facts).join(architecture_of(facts, repositories), "repo_id")
    return repositories.select("repo_id").join(done, "repo_id", "left").select("repo_id", "quality_score", "summary", F.when(F.col("summary").isNull(), "NO_CHUNKS").alias("error_code"))
