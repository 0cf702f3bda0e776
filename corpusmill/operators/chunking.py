"""Chunking (C1-C4): line windows in closed form, and definition boundaries, all within the row of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import language_tag, split_lines

#: Languages with definition chunks; where a top-level definition starts.
DEFINITIONS = {
    "py": r"^(?:(?:async\s+)?def|class)\b|^@", "go": r"^(?:func|type)\b",
    "js": r"^(?:async\s+)?function\b|^(?:abstract\s+)?class\b", "jsx": r"^(?:async\s+)?function\b|^(?:abstract\s+)?class\b",
    "ts": r"^(?:async\s+)?function\b|^(?:abstract\s+)?class\b|^interface\b|^enum\b", "tsx": r"^(?:async\s+)?function\b|^(?:abstract\s+)?class\b|^interface\b|^enum\b",
    "rs": r"^(?:pub\S*\s+)?(?:fn|struct|enum|impl|trait|mod)\b", "java": r"^(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum|record)\b",
    "cs": r"^(?:(?:public|private|internal|abstract|sealed|static)\s+)*(?:class|interface|struct|enum|namespace)\b", "php": r"^(?:abstract\s+|final\s+)?(?:class|interface|trait|function)\b",
    "rb": r"^(?:class|module|def)\b", "c": r"^[A-Za-z_][\w\s*]*\([^;]*$|^(?:struct|enum|union)\b", "h": r"^(?:struct|enum|union)\b", "cpp": r"^[A-Za-z_][\w\s*:<>]*\([^;]*$|^(?:class|struct|namespace|enum)\b", "hpp": r"^(?:class|struct|namespace|enum)\b",
}


def chunk_id(repo: Column, path: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws("|", repo, path, start.cast("string"), end.cast("string")), 256)


def window_count(n: Column, size: int, step: int) -> Column:
    return F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")


def _pieces(spans: Column, size: int, step: int) -> Column:
    """array<struct<start_line,end_line,content>>: spans (first, last) of the column `lines`, cut into windows, with their texts. Linear in the file."""

    def windows(s: Column) -> Column:
        nth = F.sequence(F.lit(0), window_count(s["last"] - s["first"] + 1, size, step) - 1)
        return F.transform(nth, lambda k: F.struct((s["first"] + k * step).cast("int").alias("a"), F.least(s["first"] + k * step + size - 1, s["last"]).cast("int").alias("z")))

    text = lambda w: F.array_join(F.slice("lines", w["a"], w["z"] - w["a"] + 1), "\n")
    return F.transform(F.flatten(F.transform(spans, windows)), lambda w: F.struct(w["a"].alias("start_line"), w["z"].alias("end_line"), text(w).alias("content")))


def _chunks(files: DataFrame, pieces: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    cut = files.select("repo_id", "file_path", "language", *keep, F.explode(pieces).alias("c")).select("repo_id", "file_path", "c.*", "language", *keep)
    return cut.withColumn("chunk_id", chunk_id(F.col("repo_id"), F.col("file_path"), F.col("start_line"), F.col("end_line")))


def _lined(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return files.select("repo_id", "file_path", language_tag(F.col("file_path")).alias("language"), split_lines(F.col("content")).alias("lines"), *keep)


def _whole() -> Column:
    one = F.array(F.struct(F.lit(1).alias("first"), F.size("lines").alias("last")))
    return F.when(F.size("lines") > 0, one).otherwise(F.slice(one, 1, 0))


def line_window_chunks(files: DataFrame, size: int = 120, overlap: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of `size` lines, each sharing `overlap` with the last; blank windows stay. Chunks have their file's columns named in `keep`."""
    if size <= overlap:
        raise ValueError("INVALID_CHUNK_CONFIG")
    return _chunks(_lined(files, keep), _pieces(_whole(), size, size - overlap), keep)


def window_spans(spans: DataFrame, size: int, overlap: int) -> DataFrame:
    """Spans (first, last) cut into windows; an overlap that leaves no step is dropped."""
    step = size - overlap if overlap < size else size
    n = F.col("last") - F.col("first") + 1
    cut = spans.where("last >= first").withColumn("i", F.explode(F.sequence(F.lit(0), window_count(n, size, step) - 1)))
    start = F.col("first") + F.col("i") * step
    return cut.withColumn("start_line", start.cast("int")).withColumn("end_line", F.least(start + size - 1, F.col("last")).cast("int")).drop("i")


def _definition_spans() -> Column:
    """Spans (first, last) of the column `lines` by `language`: a span opens at a definition, or where other code at column 0 follows one."""

    def kind(line: Column) -> Column:
        starts = F.lit(False)
        for lang, pattern in DEFINITIONS.items():
            starts = F.when(F.col("language") == lang, line.rlike(pattern)).otherwise(starts)
        at0 = line.rlike(r"^\S") & ~line.rlike(r"^(?:[}\])]|end\b|#)")
        return F.when(starts, "definition").when(at0, "gap")

    marked = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), kind(x).alias("kind"))), lambda m: m["kind"].isNotNull())

    def opening(own: Column) -> Column:
        before = lambda i: F.coalesce(F.when(i > 0, F.get(own, i - 1)["kind"]), F.lit("gap"))
        opens = F.filter(own, lambda m, i: (m["kind"] == "definition") | (before(i) == "definition"))
        return F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(opens, lambda m: m["at"])))

    def spans(starts: Column) -> Column:
        return F.transform(starts, lambda a, i: F.struct((a + 1).alias("first"), F.coalesce(F.get(starts, i + 1), F.size("lines")).alias("last")))

    # one element binds an array to a lambda variable, so that it is computed once for a file
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    found = once(once(marked, opening), spans)
    return F.when(F.col("language").isin(*DEFINITIONS) & (F.size("lines") > 0), found).otherwise(F.slice(found, 1, 0))


def _definition_pieces(size: int, overlap: int) -> Column:
    step = size - overlap if overlap < size else size
    return F.filter(_pieces(_definition_spans(), size, step), lambda c: c["content"].rlike(r"\S"))


def definition_chunks(files: DataFrame, size: int = 120, overlap: int = 20) -> DataFrame:
    """Top-level definitions whole, what lies between them as gaps, long spans cut; blank pieces go.

    A definition starts at a column-0 line of its language's pattern; any other column-0 line that is not blank and closes
    nothing starts a gap. All in the row: no shuffle.
    """
    return _chunks(_lined(files), _definition_pieces(size, overlap))


def chunk_files(files: DataFrame, size: int = 120, overlap: int = 20) -> DataFrame:
    """C4: definition chunks where the language has them and they yield something, else line windows."""
    if size <= overlap:
        raise ValueError("INVALID_CHUNK_CONFIG")
    cut = _lined(files).withColumn("defined", _definition_pieces(size, overlap))
    return _chunks(cut, F.when(F.size("defined") > 0, F.col("defined")).otherwise(_pieces(_whole(), size, size - overlap)))
