"""Audit of how text filters interact: what each of five filters removes in every order of application.

A table-driven transducer reads the UTF-8 bytes of each text once. Its state is whether the byte before belonged to a word; for a
state and a byte the table holds what happens: a word starts or ends, a code point starts, a capital or a symbol is met. Spans of
words go into an open-addressing hash table as they end. A slot is another word's only after its bytes were compared, so
distinct words are counted exactly, whatever their hashes.

The filters fail a text that has under 200 words (A), whose distinct words are under half (B), that has over 3 % capitals (C),
that holds a symbol (D), or that a smaller doc_id has too (E). Documents are counted by part, set of failed filters and labels; all
orders follow from these counts, at most 128 for each part.

Defined results: null text is empty, null lang is the part ''; a null doc_id is no smaller than any and has no smaller one; a
document with several labels is good or toxic if one of them says so; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import attach, bounded_batches, byte_slices, scratch

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
SPACES = b" \t\n\v\f\r"
#: What the transducer does at a byte.
WORD_STARTS, WORD_ENDS, CODE_POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def transition_table() -> np.ndarray:
    """Actions at [state, byte]; state 1 is inside a word, and the next state is whether the byte is no space."""
    table = np.zeros((2, 256), np.uint8)
    spaces = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
    table[0, ~spaces] |= WORD_STARTS
    table[1, spaces] |= WORD_ENDS
    table[:, (np.arange(256) & 0xC0) != 0x80] |= CODE_POINT
    table[:, ord("A") : ord("Z") + 1] |= CAPITAL
    table[:, np.frombuffer(SYMBOLS, np.uint8)] |= SYMBOL
    return table


def _bytes_equal(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[x:x + size] equals data[y:y + size], for each of the pairs."""
    n = np.cumsum(size)
    step = np.arange(n[-1] if len(n) else 0) - np.repeat(n - size, size)
    same = data[np.repeat(x, size) + step] == data[np.repeat(y, size) + step]
    return np.add.reduceat(same, n - size) == size if len(n) else np.zeros(0, bool)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each span whether it is the first of its row with its bytes. name: a hash of the bytes, equal for equal ones.

    All spans probe one table at once: of those at a free slot one takes it, and those that equal a slot's owner, byte by byte, are repeats.
    """
    size = ends - starts
    slots = 1 << max(4, (2 * len(starts)).bit_length())
    h = (name ^ rows.astype(np.uint64) * _ODD) * _ODD
    at = (h >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)
    owner = np.full(slots, -1, np.int64)
    first = np.zeros(len(starts), bool)
    left = np.arange(len(starts))
    while len(left):
        free = left[owner[at[left]] < 0]
        owner[at[free][::-1]] = free[::-1]  # the earliest span of a slot is written last
        there = owner[at[left]]
        first[left[there == left]] = True
        left, there = left[there != left], there[there != left]
        alike = (rows[left] == rows[there]) & (size[left] == size[there])
        alike[alike] = _bytes_equal(data, starts[left[alike]], starts[there[alike]], size[left[alike]])
        left = left[~alike]
        at[left] = (at[left] + 1) & (slots - 1)
    return first


def text_counts(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> dict[str, np.ndarray]:
    """words, distinct, code_points, capitals, symbols of each of the texts that lie end to end in data."""
    n, starts = len(ends), np.concatenate(([0], ends[:-1]))
    state = np.concatenate(([False], table[0, data] & WORD_STARTS > 0))  # after each byte
    state[starts] = False  # a text starts outside of a word
    did = table[state[: len(data)].astype(np.int8), data]
    sums = lambda bit: np.diff(np.concatenate(([0], np.cumsum(did & bit > 0)))[np.concatenate(([0], ends))])
    begin, stop = np.flatnonzero(did & WORD_STARTS), np.flatnonzero(did & WORD_ENDS)
    row = np.searchsorted(ends, begin, "right")
    # a word ends at the next space, or with its text
    end = np.minimum(np.append(stop, len(data))[np.searchsorted(stop, begin)], ends[row])
    power = np.full(len(data) + 1, _ODD)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sum_ = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])))
    back = np.full(len(data) + 1, _BACK)
    back[0] = 1
    name = (sum_[end] - sum_[begin]) * np.multiply.accumulate(back)[begin]
    first = distinct_spans(data, begin, end, row, name)
    return {"words": np.bincount(row, minlength=n), "distinct": np.bincount(row[first], minlength=n), "code_points": sums(CODE_POINT), "capitals": sums(CAPITAL), "symbols": sums(SYMBOL)}


def failed_filters(docs: DataFrame) -> DataFrame:
    """doc_id, part, sha (of the text) and fails, the filters A to D that the text fails as bits 1, 2, 4, 8."""
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = transition_table()
        for batch in batches:
            for b in byte_slices(batch, "text"):
                text = b["text"]
                offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset).astype(np.int64)
                whole = text.buffers()[2]
                data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
                c = text_counts(data, offsets[1:] - offsets[0], table)
                bits = [c["words"] < 200, 100 * c["distinct"] < 50 * c["words"], 100 * c["capitals"] > 3 * c["code_points"], c["symbols"] > 0]
                fails = sum(bit.astype(np.int32) << k for k, bit in enumerate(bits))
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["part"], b["sha"], pa.array(fails, pa.int32())], ["doc_id", "part", "sha", "fails"])

    text = F.coalesce("text", F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    return rows.mapInArrow(scan, "doc_id long, part string, sha binary, fails int")


def pattern_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents by the set of filters that they fail, as bits 1 to 16, and their labels."""
    rows = scratch(failed_filters(docs), "failed")
    copies = scratch(rows.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1"), "copies")
    judged = attach(rows, copies, "sha", "c", rows.count(), "left")
    fails = F.col("fails") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)
    of = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(of("quality").alias("good"), of("toxic").alias("toxic"))
    named = judged.select("part", fails.alias("fails"), "doc_id").join(known, "doc_id", "left")
    return named.groupBy("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    counts = scratch(pattern_counts(docs, labels), "patterns")
    orders = [("".join(order), step, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in order[: step - 1])) for order in permutations(FILTERS) for step, f in enumerate(order, 1)]
    steps = spark.createDataFrame([(s, *x) for s, x in enumerate(orders)], "s int, filter_order string, step int, own int, before int")  # 600 rows, whatever the documents
    met = counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))).join(F.broadcast(steps), "s")
    fails, own, before = F.col("fails"), F.col("own"), F.col("before")
    hit, earlier = fails.bitwiseAND(own) != 0, fails.bitwiseAND(before) != 0
    removed = hit & ~earlier
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    shapley = F.sum(F.when(hit, F.col("n") * F.lit(120) / F.bit_count(fails)).otherwise(0)).cast("long")  # of a document's failed filters each is the first in as many orders
    return met.groupBy("part", "filter_order", "step").agg(
        total(fails.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"), total(removed).alias("removed"), total(hit & earlier).alias("redundant"), total(fails == own).alias("unique_fails"),
        total(removed & (F.col("good") == 1)).alias("good_lost"), total(removed & (F.col("toxic") == 1)).alias("toxic_lost"), shapley.alias("shapley"),
    )
