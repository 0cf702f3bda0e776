"""Hybrid retrieval for a table of questions (R1-R9): lexical cover density, cosine top-k, fusion, re-ranking, diversity."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from corpusmill.functions.text import all_tokens, path_weight, tokens
from corpusmill.sources.tables import durable

#: Words that lexical search leaves out: fixed values.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


#: Terms that are broadcast at most, to build the part of an index that they need.
MAX_BROADCAST_TERMS = 200_000

#: Exact dense search: numbers in a block of vectors, pairs that are scored at once, and pairs of a task, more or less.
CELLS, SLICE, TASK_PAIRS = 1 << 20, 1 << 20, 1 << 27


def _indexed_text() -> Column:
    return F.concat(F.coalesce("file_path", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))


def build_lexical_index(chunks: DataFrame) -> DataFrame:
    """(repo_id, term, chunk_id, positions) over path and content. A chunk's positions are sorted and cut by term in its row: no shuffle."""
    text = _indexed_text()
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  binds an array, so that it is computed once for a row
    placed = F.sort_array(F.transform(all_tokens(text), lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))

    def by_term(words: Column) -> Column:
        first = F.filter(F.transform(words, lambda w, i: F.when((i == 0) | (F.get(words, i - 1)["term"] != w["term"]), i)), lambda i: i.isNotNull())
        cut = lambda starts: F.transform(starts, lambda a, i: F.struct(F.get(words, a)["term"].alias("term"), F.transform(F.slice(words, a + 1, F.coalesce(F.get(starts, i + 1), F.size(words)) - a), lambda w: w["pos"]).alias("positions")))
        return once(first, cut)

    spread = chunks.select("repo_id", "chunk_id", F.explode(once(placed, by_term)).alias("t"))
    return spread.select("repo_id", F.col("t.term").alias("term"), "chunk_id", F.col("t.positions").alias("positions"))


def query_terms(questions: DataFrame) -> DataFrame:
    asked = questions.select("query_id", "repo_id", F.filter(tokens(F.col("q")), lambda t: ~t.isin(*STOP_WORDS)).alias("terms")).where(F.size("terms") > 0)
    return asked.select("query_id", "repo_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("term_no", "term"))


def index_of_terms(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """The part of R1's index that questions ask for. Tokens of other terms go before anything is sorted or shuffled; with very many terms the whole index is built and cut."""
    asked = query_terms(questions).select("repo_id", "term").distinct()
    if asked.count() > MAX_BROADCAST_TERMS:
        return build_lexical_index(chunks).join(asked, ["repo_id", "term"], "left_semi")
    tokens_of = chunks.select("repo_id", "chunk_id", F.posexplode(all_tokens(_indexed_text())).alias("pos", "term"))
    met = tokens_of.join(F.broadcast(asked), ["repo_id", "term"])
    return met.groupBy("repo_id", "chunk_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions")).select("repo_id", "term", "chunk_id", "positions")


def _bucket(repo: Column, term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(repo, term), F.lit(buckets)).cast("int")


def save_lexical_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """R1, stored: folders of a hash of repository and term, sorted by both, so that a reader opens few folders and skips most of a file."""
    placed = index.withColumn("bucket", _bucket(F.col("repo_id"), F.col("term"), buckets))
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "repo_id", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def stored_lexical_index(spark: SparkSession, path: str, questions: DataFrame, buckets: int = 64) -> DataFrame:
    """Of a stored index, the buckets that questions' terms lie in; buckets as it was saved. Numbers of buckets alone reach the driver."""
    asked = query_terms(questions).select(_bucket(F.col("repo_id"), F.col("term"), buckets).alias("bucket")).distinct().collect()
    return spark.read.parquet(path).where(F.col("bucket").isin([r.bucket for r in asked])).drop("bucket")


def cover_density(n_terms: Column, hits: Column, k: int = 16) -> Column:
    """Sum over minimal covers of min(1, k / (length)), folding positions in order; hits: array<struct<pos,term_no>>."""
    start = F.struct(F.array_repeat(F.lit(-1), n_terms).alias("last"), F.lit(-1).alias("done"), F.lit(0.0).alias("score"))

    def step(a: Column, h: Column) -> Column:
        last = F.transform(a["last"], lambda p, i: F.when(i == h["term_no"], h["pos"]).otherwise(p))
        first = F.array_min(last)
        new = first > a["done"]
        gain = F.least(F.lit(1.0), F.lit(float(k)) / (h["pos"] - first + 1))
        return F.struct(last.alias("last"), F.when(new, first).otherwise(a["done"]).alias("done"), (a["score"] + F.when(new, gain).otherwise(0.0)).alias("score"))

    return F.aggregate(hits, start, step, lambda a: a["score"])


def lexical_search(index: DataFrame, chunks: DataFrame, questions: DataFrame, limit: int = 20) -> DataFrame:
    """R2: chunks that hold all terms of a question, by cover density, path, line. The index is read more than once: pass a stored one.

    Only the chunks of a question's rarest term are looked at: its other terms meet the index by chunk, so a term that all chunks hold makes no
    more rows than the rarest has, and no key is hot.
    """
    limit = max(1, min(100, limit))
    asked = query_terms(questions)
    often = index.join(asked.select("repo_id", "term").distinct(), ["repo_id", "term"], "left_semi").groupBy("repo_id", "term").agg(F.count("*").alias("df"))
    terms = F.collect_list(F.struct("term", "term_no")).alias("terms")
    rarest = asked.join(often, ["repo_id", "term"], "left").groupBy("query_id", "repo_id", "n_terms").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term_no")).alias("term"), terms)
    few = rarest.join(index.select("repo_id", "term", "chunk_id"), ["repo_id", "term"]).select("query_id", "repo_id", "chunk_id", "n_terms", F.explode("terms").alias("t"))
    met = few.select("query_id", "repo_id", "chunk_id", "n_terms", "t.term", "t.term_no").join(index, ["repo_id", "chunk_id", "term"])
    hits = F.array_sort(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("term_no").alias("term_no"))))))
    found = met.groupBy("query_id", "repo_id", "chunk_id", "n_terms").agg(F.count("*").alias("n"), hits.alias("hits")).where("n = n_terms")
    scored = found.select("query_id", "repo_id", "chunk_id", F.bround(cover_density(F.col("n_terms"), F.col("hits")), 6).alias("score"))
    placed = scored.join(chunks.select("repo_id", "chunk_id", "file_path", "start_line", "end_line", "language"), ["repo_id", "chunk_id"])
    nth = F.row_number().over(Window.partitionBy("query_id", "repo_id").orderBy(F.desc("score"), "file_path", F.asc_nulls_last("start_line"), "chunk_id"))
    return placed.withColumn("rank", nth).where(F.col("rank") <= limit)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _numbers(lists: pa.Array, length: int) -> np.ndarray:
    """(rows, length) of lists that all have that length and no null."""
    return lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(lists), length)


def _lengths(lists: pa.Array) -> np.ndarray:
    """Length of each list; -1 without one or with a null in it, which has no cosine with anything."""
    found = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if lists.flatten().null_count:
        broken = pc.list_parent_indices(lists).to_numpy()[pc.is_null(lists.flatten()).to_numpy(zero_copy_only=False)]
        found[broken] = -1
    return found


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows i of x and j of y, summed in the order of the dimensions as `dot` does, so both agree to the last bit."""
    total = np.zeros(len(i))
    for p, q in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
        total += p[i] * q[j]
    return total


def _rounded(score: np.ndarray) -> np.ndarray:
    """Ten-thousandths as bround(score, 4) has them: by the shortest decimal form where that decides."""
    scaled = score * 1e4
    whole = np.rint(scaled)
    near = np.flatnonzero(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-6)
    values, back = np.unique(score[near], return_inverse=True)
    whole[near] = np.array([float(Decimal(repr(float(v))).scaleb(4).to_integral_value(ROUND_HALF_EVEN)) for v in values])[back]
    return whole


def _floor(scores: np.ndarray, limit: int) -> np.ndarray:
    """For each row, a number that at least `limit` of its scores reach: of the best of so many strided groups, the limit-th."""
    groups = 16 * limit
    deep = scores.shape[1] // groups
    best = scores[:, : deep * groups].reshape(len(scores), deep, groups).max(axis=1) if deep > 1 else scores
    return np.partition(best, -limit, axis=1)[:, -limit] if best.shape[1] > limit else np.full(len(scores), -np.inf)


def _nearest(x: np.ndarray, y: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, cosine): for each row of x the first `limit` of y by rounded cosine, NaN first, then by place.

    One matrix product tells which pairs can be among them; their cosines are then taken as `dot` takes them. Vectors whose products could leave a
    double's range, or of no length, are always taken that way.
    """
    norms = [np.sqrt(_products(m, m, np.arange(len(m)), np.arange(len(m)))) for m in (x, y)]
    tame = [(n > 1e-100) & (n < 1e100) for n in norms]
    unit = [np.where(t[:, None], m, 0.0) / np.where(t, n, 1.0)[:, None] for m, n, t in zip((x, y), norms, tame)]
    calm, wild = np.flatnonzero(tame[1]), np.flatnonzero(~tame[1])
    there = np.ascontiguousarray(unit[1][calm].T)
    found = []
    slices = max(1, SLICE // max(1, len(y)))
    for a in range(0, len(x), slices):
        scores = unit[0][a : a + slices] @ there
        least = np.where(tame[0][a : a + slices], _floor(scores, limit) - 1.01e-4, -np.inf)  # as far apart may two scores be that round alike
        i, j = np.nonzero(scores >= least[:, None])
        i = np.concatenate([i, np.repeat(np.arange(len(scores)), len(wild))]) + a
        j = np.concatenate([calm[j], np.tile(wild, len(scores))])
        cosine = _products(x, y, i, j) / (norms[0][i] * norms[1][j])
        no = np.isnan(cosine)
        order = np.lexsort((j, -_rounded(np.where(no, 0.0, cosine)), ~no, i))
        i, j, cosine = i[order], j[order], cosine[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < limit
        found.append((i[kept], j[kept], cosine[kept]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _nearest_of_block(limit: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of questions and one of vectors: (query_id, repo_id, chunk_id, cosine) that can be among a question's first `limit`."""

    def nearest(asked: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("chunk_id")
        x, y = (t["embedding"].combine_chunks() for t in (asked, known))
        lengths, others = _lengths(x), _lengths(y)
        rows = []
        for n in np.unique(lengths) if known.num_rows else []:
            here, there = np.flatnonzero(lengths == n), np.flatnonzero((others == n) & (n >= 0))
            if len(there):
                with np.errstate(all="ignore"):
                    i, j, cosine = _nearest(_numbers(x.take(pa.array(here)), n), _numbers(y.take(pa.array(there)), n), limit)
                rows.append((here[i], there[j], cosine, np.zeros(len(i), bool)))
            rest = np.flatnonzero((others != n) | (n < 0))[: max(0, limit - len(there))]  # no cosine: after all others
            rows.append((np.repeat(here, len(rest)), np.tile(rest, len(here)), np.zeros(len(here) * len(rest)), np.ones(len(here) * len(rest), bool)))
        i, j, cosine, none = (np.concatenate(part) for part in zip(*rows)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
        return pa.table({"query_id": asked["query_id"].take(pa.array(i)), "repo_id": asked["repo_id"].take(pa.array(i)), "chunk_id": known["chunk_id"].take(pa.array(j)), "cosine": pa.array(cosine, mask=none)})

    return nearest


def dense_search(vectors: DataFrame, questions: DataFrame, limit: int = 20) -> DataFrame:
    """The most similar vectors of the question's repository, exactly: all pairs are scored.

    A repository's questions and vectors are dealt into blocks of some CELLS numbers; each block of vectors meets each block of questions in a group of its
    own, where one matrix product finds the pairs that can be among the first. The groups' first ones are ranked together. What a task holds doesn't
    grow with the input or with a repository. Rows of a length other than the question's or with nulls have no score and come last.
    """
    numbers = lambda c: F.col(c) if dict(questions.dtypes)[c] == dict(vectors.dtypes)[c] == "array<float>" else F.col(c).cast("array<double>")
    asked = questions.where("embedding is not null and repo_id is not null").select("query_id", "repo_id", numbers("embedding").alias("embedding"))
    known = vectors.where("chunk_id is not null and repo_id is not null").select("repo_id", "chunk_id", numbers("embedding").alias("embedding"))
    cells = F.sum(F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(16)).cast("long"))
    count = lambda rows, name: rows.groupBy("repo_id").agg(F.count("*").alias(name), F.ceil(cells / CELLS).cast("int").alias(f"{name}_parts"))
    sizes = durable(count(known, "known").join(count(asked, "asked"), "repo_id"), "sizes")
    units, work = sizes.agg(F.sum(F.col("known_parts").cast("double") * F.col("asked_parts")), F.sum(F.col("known").cast("double") * F.col("asked"))).first()
    large = F.broadcast(sizes.where("known_parts > 1 or asked_parts > 1").select("repo_id", "known_parts", "asked_parts"))

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row with the number of its own block, once for each block of the other side."""
        parts = lambda c: F.coalesce(f"{c}_parts", F.lit(1))
        numbered = rows.join(large, "repo_id", "left").withColumn("own", F.pmod(F.xxhash64(key), parts(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts(other) - 1)))
        return numbered.select(*[F.col(c).alias(c) for c in rows.columns], F.col("own").alias(own), F.col("other").alias(other))  # both sides may be one table: new columns

    keys = ["repo_id", "known", "asked"]
    usual = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = int(max(1, min(units or 0, max(usual, min((work or 0) / TASK_PAIRS, 100_000)))))
    pairs = [dealt(*side).repartition(n, *keys).groupBy(*keys) for side in ((asked, "query_id", "asked", "known"), (known, "chunk_id", "known", "asked"))]
    kinds = [asked.schema["query_id"], asked.schema["repo_id"], known.schema["chunk_id"]]
    best = pairs[0].cogroup(pairs[1]).applyInArrow(_nearest_of_block(limit), StructType([StructField(k.name, k.dataType) for k in kinds] + [StructField("cosine", DoubleType())]))
    scored = best.select("query_id", "repo_id", "chunk_id", F.bround("cosine", 4).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id", "repo_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= limit)


def min_max(value: Column, window) -> Column:
    """To 0..1 within the window; 1 if all are equal."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))


def path_overlap(q: Column, path: Column, language: Column) -> Column:
    """Share of the question's tokens that path and language hold."""
    asked, there = tokens(q), tokens(F.concat_ws(" ", path, language))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, there)) / F.size(asked)).otherwise(0.0)


def hybrid_search(lexical: DataFrame, dense: DataFrame, chunks: DataFrame, questions: DataFrame, limit: int = 20) -> DataFrame:
    """Both result lists merged; 0.5 dense + 0.4 lexical + 0.1 path overlap, each min-max normalised by question."""
    keys = ["query_id", "repo_id", "chunk_id"]
    lex = lexical.select(*keys, F.col("score").alias("lexical"))
    both = lex.join(dense.select(*keys, F.col("score").alias("dense")), keys, "full_outer").na.fill(0.0, ["lexical", "dense"])
    known = both.join(chunks.select("repo_id", "chunk_id", "file_path", "start_line", "end_line", "language"), ["repo_id", "chunk_id"], "left").join(questions.select("query_id", "repo_id", "q"), ["query_id", "repo_id"])
    asked = Window.partitionBy("query_id", "repo_id")
    score = 0.5 * min_max(F.col("dense"), asked) + 0.4 * min_max(F.col("lexical"), asked) + 0.1 * path_overlap(F.col("q"), F.col("file_path"), F.col("language"))
    scored = known.withColumn("score", F.bround(score, 6))
    nth = F.row_number().over(asked.orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= max(1, min(100, limit))).select(*keys, "file_path", "start_line", "end_line", "language", "score", "rank")


def hydrate_content(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Content for the results alone."""
    return results.join(chunks.select("repo_id", "chunk_id", "content"), ["repo_id", "chunk_id"], "left")


def term_overlap(q: Column, text: Column) -> Column:
    """The built-in scorer: share of the question's tokens in the text."""
    asked = tokens(q)
    return F.when(F.size(asked) > 0, F.bround(F.size(F.array_intersect(asked, tokens(text))) / F.size(asked), 6)).otherwise(0.0)


def rerank(results: DataFrame, questions: DataFrame, most: int = 50, scorer: Callable[[Column, Column], Column] = term_overlap) -> DataFrame:
    """The first `most` results of a question get the scorer's score of question and text; one missing score leaves all as they were.

    results are all merged candidates (R6 without a cut); equal scores go by chunk_id. Cut what comes out.
    """
    known = results.join(questions.select("query_id", "repo_id", "q"), ["query_id", "repo_id"])
    text = F.concat(F.coalesce("file_path", F.lit("")), F.lit("\n"), F.coalesce("language", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    asked = Window.partitionBy("query_id", "repo_id")
    new = known.withColumn("new", F.when(F.col("rank") <= most, scorer(F.col("q"), text)))
    failed = F.max((F.col("new").isNull() & (F.col("rank") <= most)).cast("int")).over(asked) == 1
    final = new.withColumn("score", F.when(failed | F.col("new").isNull(), F.col("score")).otherwise(F.col("new")))
    nth = F.row_number().over(asked.orderBy(F.desc("score"), "chunk_id"))
    return final.withColumn("new_rank", nth).drop("rank", "new", "q").withColumnRenamed("new_rank", "rank")


def diverse_select(results: DataFrame, limit: int = 6) -> DataFrame:
    """By kind of path, each path once, two of a folder at most; then filled up in the old order."""
    asked = ["query_id", "repo_id"]
    first = F.row_number().over(Window.partitionBy(*asked, "file_path").orderBy("rank"))
    kept = results.where("coalesce(file_path, '') != ''").withColumn("nth", first).where("nth = 1").withColumn("weight", path_weight(F.col("file_path")))
    folder = F.split("file_path", "/")[0]
    in_folder = F.row_number().over(Window.partitionBy(*asked, folder).orderBy("weight", "rank"))
    kept = kept.withColumn("in_folder", in_folder)
    phase1 = kept.where("in_folder <= 2").withColumn("place", F.row_number().over(Window.partitionBy(*asked).orderBy("weight", "rank"))).where(F.col("place") <= limit).withColumn("phase", F.lit(1))
    rest = results.join(phase1.select(*asked, "chunk_id"), [*asked, "chunk_id"], "left_anti").withColumn("place", F.col("rank")).withColumn("phase", F.lit(2))
    columns = [*asked, "chunk_id", "file_path", "phase", "place"]
    every = phase1.select(*columns).unionByName(rest.select(*columns))
    nth = F.row_number().over(Window.partitionBy(*asked).orderBy("phase", "place"))
    return every.withColumn("pick", nth).where(F.col("pick") <= limit).select(*asked, "chunk_id", "file_path", "pick")
