"""Import graph (G1-G5): file texts, imports, resolution by candidate lists, edges, blast radius by frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import discard, durable, join_few

#: Suffixes of scripts, and what an import or a require looks like there; the names of an import may take several lines.
JS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
JS_IMPORT = r"""(?:import|export)\s+(?:[^'"]+?\s+from\s+)?['"]([^'"]+)['"]"""
JS_REQUIRE = r"""require\(\s*['"]([^'"]+)['"]\s*\)"""


def merge_file_text(chunks: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """G1: chunks of a file joined in order; one file's chunks come together.

    Where several texts have one path, chunks that start at the same line go by the columns `order`, say the row of their text, and by content last.
    """
    path = F.regexp_replace("file_path", r"\\", "/")
    kept = chunks.where((F.coalesce("file_path", F.lit("")) != "") & (F.coalesce("content", F.lit("")) != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", *order, "content"))), lambda x: x["content"]), "\n")
    return kept.groupBy("repo_id", path.alias("file_path")).agg(text.alias("content"))


def extract_imports(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, ref, kind) of every import statement."""
    py, js = F.lower("file_path").endswith(".py"), F.lower("file_path").rlike(r"\.(?:ts|tsx|js|jsx|mjs|cjs)$")
    find = lambda pattern: F.regexp_extract_all("content", F.lit(pattern), 1)
    plain = F.flatten(F.transform(find(r"(?m)^[ \t]*import[ \t]+([^\n#]+)"), lambda x: F.split(x, ",")))
    modules = F.transform(plain, lambda x: F.trim(F.regexp_replace(x, r"(?s)[ \t]+as[ \t].*$", "")))
    dotted = find(r"(?m)^[ \t]*from[ \t]+([a-zA-Z0-9_.]+)[ \t]+import[ \t]+")
    quoted = F.concat(find(JS_IMPORT), find(JS_REQUIRE))
    refs = files.select("repo_id", "file_path", F.when(py, F.concat(modules, dotted)).when(js, quoted).otherwise(F.array().cast("array<string>")).alias("refs"), F.when(py, "python").otherwise("javascript").alias("kind"))
    return refs.select("repo_id", "file_path", F.explode("refs").alias("ref"), "kind").where("ref != ''").distinct()


def normpath(path: Column) -> Column:
    """Fold `.` and `..` of a path, as a pure expression."""
    step = lambda a, x: F.when((x == ".") | (x == ""), a).when((x == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The first candidate path that is a file of the repository; (repo_id, source, target, kind)."""
    folder = F.regexp_replace("file_path", "[^/]*$", "")
    dotted = F.regexp_replace(F.regexp_replace("ref", r"^\.+", ""), r"\.", "/")
    python = F.when(dotted != "", F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")), normpath(F.concat(folder, dotted, F.lit(".py")))))
    base = normpath(F.concat(folder, F.col("ref")))
    guesses = F.array(*[F.concat(base, F.lit(f"{way}.{ext}")) for ext in JS for way in ("", "/index")])
    js = F.when(F.col("ref").startswith("."), F.when(base.rlike(r"\.(?:ts|tsx|js|jsx|mjs|cjs)$"), F.array(base)).otherwise(guesses))
    tries = imports.select("repo_id", F.col("file_path").alias("source"), "ref", "kind", F.posexplode(F.when(F.col("kind") == "python", python).otherwise(js)).alias("nth", "target"))
    # a file that all others import is one key with a row from each
    found = join_few(durable(tries, "tries"), files.select("repo_id", F.col("file_path").alias("target")), ["repo_id", "target"])
    return found.groupBy("repo_id", "source", "ref", "kind").agg(F.min_by("target", "nth").alias("target")).select("repo_id", "source", "target", "kind")


def dependency_edges(chunks: DataFrame) -> DataFrame:
    """Distinct edges between different files."""
    files = merge_file_text(chunks)
    return resolve_imports(extract_imports(files), files).where("source != target").distinct().withColumn("id", F.concat("source", F.lit("->"), "target"))


def graph_stats(chunks: DataFrame) -> DataFrame:
    nodes = merge_file_text(chunks).groupBy("repo_id").agg(F.count("*").alias("nodes"))
    edges = dependency_edges(chunks).groupBy("repo_id").agg(F.count("*").alias("edges"))
    return nodes.join(edges, "repo_id", "left").select("repo_id", "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def _doubled(hops: DataFrame, most: int) -> DataFrame | None:
    """Hops (repo_id, file_path, source) of twice the length; None if more than `most` pairs would meet at their middles."""
    here = hops.groupBy("repo_id", "file_path").agg(F.count("*").alias("out"))
    there = hops.groupBy("repo_id", F.col("source").alias("file_path")).agg(F.count("*").alias("into"))
    pairs = here.join(there, ["repo_id", "file_path"]).agg(F.coalesce(F.sum(F.col("out") * F.col("into")), F.lit(0))).first()[0]
    if pairs > most:
        return None
    first = hops.select("repo_id", "file_path", F.col("source").alias("middle"))
    second = hops.select("repo_id", F.col("file_path").alias("middle"), "source")
    return durable(first.join(second, ["repo_id", "middle"]).where("file_path != source").select("repo_id", "file_path", "source").distinct(), "hops")


def blast_radius(edges: DataFrame, changed: DataFrame, widest: int = 4, max_rounds: int = 10_000) -> DataFrame:
    """Files that import a changed file (repo_id, file_path), directly or not; changed files are not counted.

    Other columns of changed, such as a commit, keep apart what is asked at once. Hops double their length in each round, from one import to 2, 4, 8
    and so on: after a round with hops of length n all files nearer than 2 n are known, so rounds are logarithmic in depth. Hops stop
    doubling when the longer ones would outnumber `widest` times the imports; then each round adds files of that length's distance, and
    meets only new ones. Each round is written to the shared folder, the one before it deleted; only counts reach the driver.
    """
    keys = [c for c in changed.columns if c != "file_path"]
    hops = durable(edges.select("repo_id", F.col("target").alias("file_path"), "source").distinct(), "hops")
    most = widest * hops.count()
    first = durable(changed.select(*keys, "file_path").distinct(), "changed")
    seen = ahead = first
    doubling = True
    for _ in range(max_rounds):
        step = ahead.join(hops, ["repo_id", "file_path"]).select(*keys, F.col("source").alias("file_path")).distinct()
        new = durable(step.join(seen, [*keys, "file_path"], "left_anti"), "new")
        if new.isEmpty():
            return seen.join(first, [*keys, "file_path"], "left_anti")
        known = durable(seen.union(new), "seen")
        longer = _doubled(hops, most) if doubling else None
        doubling = longer is not None
        if seen is not first:
            discard(seen)
        if doubling:
            discard(hops)
            hops = longer
        seen, ahead = known, known if doubling else new
    raise RuntimeError(f"blast radius takes more than {max_rounds} rounds")
