"""Audit of how the sources of a language differ in their words, by count cells.

A term's probability in a group depends on its count there alone, so the divergence of a term is a function of two counts. Terms
with the same pair of counts make a cell: the function is evaluated once for each cell, and a cell stands for as many terms as it
has. To rank the terms of a group, cells are merged by equal value, ranked by the terms that come before them, and only
cells that reach the first ranks are expanded into their terms, in UTF-8 order. To compare two sources, cells of terms that only one
of them has come from the counts of that source; only terms that both have are counted by pair of counts.

Probabilities are whole numbers, 1 + floor(10^9 (count + 1) / (N + V)), in exact arithmetic: products in decimals of 38 digits,
quotients by whole division.

Defined results: null text, lang and source are ''; a document without terms makes a group too; a lang without kept terms gives
pairs of value 0; rows that repeat count as documents; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.shared import attach, bounded_batches, scratch

#: A-Z become small, other ASCII characters but letters part terms.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Terms that a task holds before it hands on their counts.
HELD_TERMS = 200_000
SCALE = 1_000_000_000


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, df): occurrences and documents of each term in each group, as partial sums of the tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in counts.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in terms], pa.int64())], ["lang", "source", "term", "count", "df"])
            counts.clear()

        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].cast(pa.binary()).to_pylist()):
                n, df = counts.setdefault((lang, source), (Counter(), Counter()))
                terms = text.translate(TERM_BYTES).split()
                n.update(terms)
                df.update(set(terms))
            if sum(len(n) for n, _ in counts.values()) > HELD_TERMS:
                yield from flush()
        yield from flush()

    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(scan, "lang string, source string, term string, count long, df long")


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)), exactly."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), (n + v).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q). Both are at most 10^9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


class _Terms:
    """Kept terms of each lang, and counts of groups."""

    def __init__(self, docs: DataFrame, least_documents: int) -> None:
        counts = scratch(count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("c"), F.sum("df").alias("df")), "counts")
        own = F.collect_list(F.struct("source", "c"))  # an entry for each source of the lang at most
        kept = counts.groupBy("lang", "term").agg(F.sum("c").alias("total"), F.sum("df").alias("df"), own.alias("own")).where(F.col("df") >= least_documents)
        self.kept = scratch(kept.select("lang", "term", "total", F.array_sort("own").alias("own")), "kept")
        self.langs = scratch(self.kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n")), "langs")
        #: Terms of a lang with the same counts in all sources, as one row.
        self.cells = scratch(self.kept.groupBy("lang", "own").agg(F.count("*").alias("m")), "vectors")
        places = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        sizes = self.cells.select("lang", "m", F.explode("own").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum(F.col("x.c") * F.col("m")).alias("n"), F.sum("m").alias("terms"))
        groups = places.join(sizes, ["lang", "source"], "left").join(self.langs, "lang", "left")
        self.groups = scratch(groups.na.fill(0, ["n", "terms", "v", "lang_n"]), "groups")


def pair_values(terms: _Terms) -> DataFrame:
    """(lang, source, item, value): for each two sources of a lang the sum of the divergence over all kept terms.

    With f of the counts (x, y), the sum is that over all x of f(x, 0), over all y of f(0, y), f(0, 0) for what is in neither, and for terms in both
    what f(x, y) differs from this.
    """
    g = terms.groups
    first = g.select("lang", "source", "v", F.col("n").alias("n1"), F.col("terms").alias("t1"))
    other = g.select("lang", F.col("source").alias("item"), F.col("n").alias("n2"), F.col("terms").alias("t2"))
    pairs = scratch(first.join(other, "lang").where("source != item"), "pairs")  # as many rows as the result has
    joint = terms.cells.where("size(own) > 1").select("lang", "m", "own", F.explode("own").alias("x")).select("lang", "m", "x", F.explode("own").alias("y")).where("x.source != y.source")
    joint = joint.groupBy("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), F.col("x.c").alias("x"), F.col("y.c").alias("y")).agg(F.sum("m").alias("m"))
    single = scratch(terms.cells.select("lang", "m", F.explode("own").alias("x")).groupBy("lang", "x.source", "x.c").agg(F.sum("m").alias("m")), "single")
    f = lambda x, y: divergence(probability(x, F.col("n1"), F.col("v")), probability(y, F.col("n2"), F.col("v"))).cast("decimal(38,0)")
    none = F.lit(0).cast("long")
    m = F.col("m").cast("decimal(19,0)")
    place = ["lang", "source", "item"]
    both = joint.join(pairs, place).select(*place, (m * (f(F.col("x"), F.col("y")) - f(F.col("x"), none) - f(none, F.col("y")) + f(none, none))).cast("decimal(38,0)").alias("value"))
    left = pairs.join(single.withColumnRenamed("c", "x"), ["lang", "source"]).select(*place, (m * f(F.col("x"), none)).cast("decimal(38,0)").alias("value"))
    right = pairs.join(single.select("lang", F.col("source").alias("item"), F.col("c").alias("y"), "m"), ["lang", "item"]).select(*place, (m * f(none, F.col("y"))).cast("decimal(38,0)").alias("value"))
    neither = (F.col("v") - F.col("t1") - F.col("t2")).cast("decimal(19,0)")
    rest = pairs.select(*place, F.when(F.col("v") > 0, neither * f(none, none)).otherwise(0).cast("decimal(38,0)").alias("value"))
    return both.unionByName(left).unionByName(right).unionByName(rest).groupBy(*place).agg(F.sum("value").cast("long").alias("value"))


def term_ranks(terms: _Terms, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms of a group that stand out most against its lang."""
    each = terms.cells.select("lang", "m", F.explode("own").alias("x"), F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("total"))
    cells = each.groupBy("lang", F.col("x.source").alias("source"), F.col("x.c").alias("c"), "total").agg(F.sum("m").alias("m")).join(terms.groups, ["lang", "source"])
    p, q = probability(F.col("c"), F.col("n"), F.col("v")), probability(F.col("total"), F.col("lang_n"), F.col("v"))
    cells = scratch(cells.select("lang", "source", "c", "total", "m", p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "c", "total", "m", divergence(F.col("p"), F.col("q")).alias("value")), "cells")
    own = Window.partitionBy("lang", "source")
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    values = values.withColumn("nth", F.row_number().over(own.orderBy(F.desc("value")))).where(F.col("nth") <= ranks)
    before = F.coalesce(F.sum("m").over(own.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = scratch(values.withColumn("before", before).where(F.col("before") < ranks).select("lang", "source", "value", "before"), "reached")
    some = cells.join(reached, ["lang", "source", "value"]).select(F.struct("lang", "source", "c", "total").alias("cell"), "m", "value", "before")
    rows = terms.kept.select("lang", "term", "total", F.explode("own").alias("x")).select(F.struct("lang", "x.source", "x.c", "total").alias("cell"), "term")
    met = attach(rows, scratch(some, "some"), "cell", "m", terms.groups.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0])
    nth = F.row_number().over(Window.partitionBy("cell.lang", "cell.source", "value").orderBy("term"))
    placed = met.withColumn("nth", nth).where(F.col("nth") <= ranks).withColumn("rank", F.col("before") + F.col("nth")).where(F.col("rank") <= ranks)
    return placed.select("cell.lang", "cell.source", F.col("term").alias("item"), "value", F.col("rank").cast("int").alias("rank"))


def audit_sources(docs: DataFrame, ranks: int = 200, least_documents: int = 3) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources of the lang by divergence (part pair), terms of the group by divergence from the lang (part term)."""
    terms = _Terms(docs, least_documents)
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs = pair_values(terms).select("lang", "source", F.lit("pair").alias("part"), "item", "value", nth.alias("rank"))
    return pairs.unionByName(term_ranks(terms, ranks).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
