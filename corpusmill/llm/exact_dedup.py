"""Exact deduplication: a Bloom filter finds texts that may repeat; only their rows shuffle.

Pass 1 hashes every normalised text to one slot of a Bloom filter, 64 slots for each row, and keeps the slots that two rows or
more have hit: what is exchanged of a row is the number of its slot, once for each partition that hits it. Pass 2 tests
every row against these slots: a row whose slot no other row hits is unique and passes straight through; the others are
grouped by the SHA-256 of their text. A false positive costs a shuffled row, never a wrong result.

Slots that repeat are broadcast as words of 64, at most `max_words` of them. Where there are more, the filter is folded to half its slots
until it fits: it keeps all repeated slots, and the share of unique rows that it lets through to the shuffle grows with copies and rows, to 18 % at
67 million rows with one copy in 12, and on from there. A cluster of large executors should give it more words. Whatever passes, duplicate_report
shuffles hashes and ids, never texts.

Defined results: null text counts as empty; a null doc_id comes after all others; rows that repeat both doc_id and text
keep one row; an empty table gives an empty table; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import MAX_BROADCAST_BLOCKS, SPACE, attach, fresh, scratch

SLOTS_PER_ROW = 64


def text_sha256(text: Column) -> Column:
    """SHA-256 in lowercase hex of the text with each run of white space replaced by one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def slot_count(n_rows: int) -> int:
    return 1 << max(16, (max(1, n_rows) * SLOTS_PER_ROW - 1).bit_length())


def repeated_slots(hashes: DataFrame, slots: int) -> DataFrame:
    """(word, twice): of the 64 slots of a word, bit b of `twice` is set if two rows or more of column `h` hit slot b. Words without such a slot are left out."""
    hit = hashes.groupBy(F.pmod("h", F.lit(slots)).alias("slot")).count().where("count > 1")
    return hit.groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("twice"))


def folded(repeated: DataFrame, slots: int, max_words: int) -> tuple[DataFrame, int]:
    """The filter (a scratch table of repeated_slots) in at most max_words words, and its slots: upper halves are laid over lower ones."""
    while slots > 64 and repeated.count() > max_words:
        slots //= 2
        half = repeated.groupBy(F.pmod("word", F.lit(max(1, slots // 64))).alias("word")).agg(F.bit_or("twice").alias("twice"))
        repeated = scratch(half, "bloom")
    return repeated, slots


def flag_repeats(rows: DataFrame, h: str, repeated: DataFrame, slots: int, flag: str) -> DataFrame:
    """Add the boolean `flag`: the filter (of repeated_slots or folded) can't rule out that another row has the same hash."""
    word, twice = fresh(rows, "__word"), fresh(rows, "__twice")
    right = F.broadcast(repeated.select(F.col("word").alias(word), F.col("twice").alias(twice)))
    slot = F.pmod(F.col(h), F.lit(slots))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    joined = rows.withColumn(word, F.floor(slot / 64)).join(right, word, "left")
    return joined.withColumn(flag, F.coalesce(F.col(twice), F.lit(0)).bitwiseAND(bit) != 0).drop(word, twice)


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_BROADCAST_BLOCKS) -> DataFrame:
    """One row for each document: doc_id, keep_id (smallest doc_id of its text), group_size, kept, text_sha256."""
    sha = F.unhex(text_sha256(F.col(text_col)))
    digests = scratch(docs.select(F.col(id_col).alias("doc_id"), sha.alias("sha")).withColumn("h", F.xxhash64("sha")), "digests")
    n_rows = digests.count()
    slots = slot_count(n_rows)
    bloom, slots = folded(scratch(repeated_slots(digests, slots), "bloom"), slots, max_words)
    flagged = flag_repeats(digests, "h", bloom, slots, "repeats")
    alone = flagged.where(~F.col("repeats")).select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    copies = scratch(flagged.where("repeats").groupBy("sha", "doc_id").agg(F.count("*").alias("copies")), "copies")
    groups = scratch(copies.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    several = attach(copies, groups, "sha", "group_size", n_rows).withColumn("nth", F.explode(F.expr("sequence(1L, copies)")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    several = several.select("doc_id", "sha", "keep_id", "group_size", kept.alias("kept"))
    return alone.unionByName(several).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_BROADCAST_BLOCKS) -> DataFrame:
    """The rows of docs without those whose text an earlier doc_id has; all columns stay. Unflagged rows never shuffle."""
    sha, h, flag = fresh(docs, "__sha"), fresh(docs, "__h"), fresh(docs, "__repeats")
    hashed = docs.withColumn(sha, F.unhex(text_sha256(F.col(text_col)))).withColumn(h, F.xxhash64(sha))
    slots = slot_count(docs.count())
    bloom, slots = folded(scratch(repeated_slots(hashed.select(F.col(h).alias("h")), slots), "bloom"), slots, max_words)
    flagged = flag_repeats(hashed, h, bloom, slots, flag)
    alone = flagged.where(~F.col(flag)).select(*docs.columns)
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*plain))
    first = flagged.where(F.col(flag)).groupBy(sha).agg(F.min_by(F.struct(*docs.columns), order).alias("first"))
    return alone.unionByName(first.select("first.*"))
