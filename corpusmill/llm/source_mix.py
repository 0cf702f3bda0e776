"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points, one for each slot, are mapped through the sources' cumulative target weights; a slot takes the next
block of its source. Blocks hold equal numbers of words of the source's stream, whose documents are shuffled by the MD5
of their id. Slots beyond a source's quota are dropped, missing ones come after the sequence, and the last one is cut, so
that each source gives its target to the word.

Defined results: null text has size 0 and is never taken; a null source is a source of its own, last in order; documents
that repeat an id stand side by side in the stream; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.shared import WORD, attach, fresh, running_start, scratch

GOLDEN = 0.6180339887498949
SLOTS = 1 << 17
CELLS = 4096


def source_key(source: Column) -> Column:
    """A join key that also tells a null source from all others."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, slots: int = SLOTS) -> DataFrame:
    """One row for each source: its size, target, share of all targets (lo, hi), block length, blocks and quota of slots.

    Sources share budget * total by weight; a target stops at cap * size and the excess goes to the others by weight
    (the water level of the sources sorted by cap / weight). The windows here sort one row for each source.
    """
    t = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    t = t.withColumn("nth", nth).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1))
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(everything)).withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    full, used = F.coalesce(F.sum("source_size").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("level", (budget * F.col("total") - cap * full) / (F.sum("weight").over(everything) - used))
    t = t.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything))
    t = t.withColumn("target", F.when(F.col("ratio") < F.col("level"), cap * F.col("source_size")).otherwise(F.col("level") * F.col("weight")))
    upto = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("sum", F.sum("target").over(everything)).withColumn("hi", F.when(F.col("sum") > 0, F.sum("target").over(upto) / F.col("sum")).otherwise(0.0))
    t = t.withColumn("hi", F.when((F.col("sum") > 0) & (F.col("nth") == F.max("nth").over(everything)), 1.0).otherwise(F.col("hi")))
    t = t.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("nth")), F.lit(0.0)))
    t = t.withColumn("words", F.round("target").cast("long")).withColumn("block_words", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("sum") / slots)))
    size = F.greatest(F.col("source_size"), F.lit(1).cast("long"))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words"))).withColumn("rest", F.col("words") % size)
    quota = F.expr("words div greatest(source_size, 1L)") * F.col("blocks") + F.ceil(F.col("rest") / F.col("block_words"))
    return t.withColumn("quota", quota).select("key", "source", "rows", "source_size", "target", "lo", "hi", "block_words", "blocks", "rest", "quota")


def mix_schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The mix, slot by slot: slot, key, block of the source's stream, and the words that the slot takes of it."""
    u = F.pmod((F.col("slot") + 0.5) * GOLDEN, F.lit(1.0))
    points = targets.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("u", u).withColumn("cell", F.floor(u * CELLS))
    cells = targets.where("hi > lo").select("key", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    hits = points.join(cells, "cell").where("u >= lo and u < hi").select("slot", "key", F.expr("slot div 1024").alias("stretch"), F.lit(1).alias("one"))
    ranked = running_start(hits, "key", "stretch", [F.col("slot")], "one", "nth").select("slot", "key", "nth")
    have = ranked.groupBy("key").agg(F.count("*").alias("have"))
    lacking = targets.join(have, "key", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("quota > have")
    late = lacking.select(F.lit(slots).cast("long").alias("slot"), "key", F.explode(F.expr("sequence(have, quota - 1)")).alias("nth"))
    dealt = ranked.unionByName(late).join(targets.drop("source"), "key").where("nth < quota").withColumn("block", F.expr("nth % blocks"))
    whole = F.least(F.col("block_words"), F.col("source_size") - F.col("block") * F.col("block_words"))
    cut = F.when((F.col("nth") == F.col("quota") - 1) & (F.col("rest") > 0), F.col("rest") - F.expr("(rest - 1) div block_words") * F.col("block_words"))
    return dealt.select("slot", "key", "nth", "block", F.coalesce(cut, whole).alias("words"), whole.alias("block_size"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, slots: int = SLOTS) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken (words of it in the mix, repeats counted)."""
    key = source_key(F.col("source"))
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    sized = scratch(sized.withColumn("deal", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sized")
    targets = scratch(source_targets(sized, weights, budget, cap, slots), "targets")
    n_rows = sized.count()
    known = attach(sized.drop("source"), targets.select("key", "source", "rows", "source_size", "target", "block_words"), "key", "rows", n_rows)
    digits = 1
    while digits < 8 and 16**digits * 2048 < n_rows:
        digits += 1
    known = known.withColumn("bucket", F.substring("deal", 1, digits))
    placed = running_start(known, "key", "bucket", [F.col("deal"), F.col("doc_id"), F.col("size")], "size", "start")
    takes = mix_schedule(targets, slots).groupBy("key", "block").agg(F.sum(F.when(F.col("words") == F.col("block_size"), 1).otherwise(0)).alias("times"), F.max(F.when(F.col("words") < F.col("block_size"), F.col("words"))).alias("cut"))
    names = ["key", "start", "doc_id", "source", "size", "source_size", "target"]
    parts = placed.where("size > 0").select(*names, "block_words", F.explode(F.expr("sequence(start div block_words, (start + size - 1) div block_words)")).alias("block"))
    parts = parts.join(takes, ["key", "block"], "left")
    at = F.col("block") * F.col("block_words")
    first, last = F.greatest("start", at), F.least(F.col("start") + F.col("size"), at + F.col("block_words"))
    some = F.when(F.col("cut").isNotNull(), F.greatest(F.lit(0).cast("long"), F.least(last, at + F.col("cut")) - first)).otherwise(0)
    words = F.coalesce("times", F.lit(0)) * (last - first) + some
    taken = parts.withColumn("words", words).groupBy(*names).agg(F.sum("words").alias("taken"))
    empty = placed.where("size = 0").select(*names, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, to the nearest whole document: none, once or more; all columns stay."""
    times, nth, marker = fresh(docs, "__times"), fresh(docs, "__nth"), fresh(docs, "__row")
    taken = mix_sources(docs, **options).where("size > 0").select("doc_id", F.col("size").alias("__size"), source_key(F.col("source")).alias("__key"), F.round(F.col("taken") / F.col("size")).cast("long").alias(times))
    taken = taken.where(F.col(times) > 0).groupBy("doc_id", "__size", "__key").agg(F.sum(times).alias(times), F.count("*").alias(marker))
    size = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long")
    match = docs["doc_id"].eqNullSafe(taken["doc_id"]) & (size == taken["__size"]) & (source_key(docs["source"]) == taken["__key"])
    often = F.ceil(taken[times] / taken[marker]).cast("long")
    joined = docs.join(taken, match).select(*[docs[c] for c in docs.columns], F.sequence(F.lit(1).cast("long"), often).alias(nth))
    return joined.withColumn(nth, F.explode(nth)).drop(nth)
