"""Removal of repeated passages: every byte covered by a 200-byte string that also starts elsewhere goes.

Each window of `length` bytes is named by its anchor, the leftmost 64-byte string of least hash in it, so equal windows have
equal anchors. The window starts of one anchor are consecutive; what they cover, 200 bytes and a little more, is the
anchor's context. Three scans over the texts follow: the first counts anchors; the second digests the contexts of anchors that
may repeat, and contexts that occur twice or more are repeated whole; the third cuts out the bytes of the contexts that
occur once although their anchor repeats, the edges of passages, and one context of each class with the same anchor.

Those are indexed in shards of bounded bytes by anchor. A shard sorts the suffixes of its contexts, run-compresses their
Burrows-Wheeler transform and keeps the suffix positions at both ends of each run. The longest match of a suffix with its
neighbours is compared byte by byte only at run ends; from there it is streamed through the text, one less at each step,
until the next sample. What reaches 200 bytes is marked. An anchor with more than `hot` contexts is no index's: digests of its
windows are counted instead, summed before they are exchanged, so that no task holds it.

Defined results: null text is empty; texts under 200 bytes keep all; documents with equal texts are each other's copies;
rows that repeat a doc_id count as documents; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import attach, bloom_array, bounded_batches, byte_slices, discard, in_bloom, scratch

LENGTH = 200
#: Bytes of an anchor, a power of two.
ANCHOR = 64
#: Bytes of contexts in a shard, on average, and contexts of one anchor that a shard takes at most.
SHARD_BYTES, HOT = 1 << 20, 2048
#: Bytes that are hashed at once.
BLOCK = 1 << 22
#: Multipliers that join two halves of a string, from the golden ratio, and low bits that hold a position.
_JOIN = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) | 1) & (1 << 64) - 1) for k in range(ANCHOR.bit_length())]
_AT = np.uint64((1 << 27) - 1)


def _bytes_table() -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(bytes([b])) for b in range(256)), np.uint64, 256)


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, start, end, place of the anchor) of every context of the texts data[starts:ends], in order; starts and ends are those of texts with `length` bytes or more.

    A text beyond BLOCK bytes is read in pieces that share the bytes of the windows across their border, so memory is bounded; a context may end at a border.
    """
    if len(data) <= BLOCK:
        return _contexts(data, starts, ends, table, length)
    found = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        for a in range(start, end - length + 1, BLOCK):
            piece = data[a : min(a + BLOCK + length - 1, end)]
            key, *places = _contexts(piece, np.array([0]), np.array([len(piece)]), table, length)
            found.append((key, *[p + a for p in places]))
    return tuple(map(np.concatenate, zip(*found))) if found else _contexts(data[:0], starts[:0], ends[:0], table, length)


def _contexts(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """contexts, of at most 2^27 bytes."""
    if not len(starts):
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    h, size = table[buffer], 1
    while size < ANCHOR:  # hashes of strings twice as long
        h = h[:-size] * _JOIN[size.bit_length()] + h[size:]
        size *= 2
    low = (h & ~_AT) | np.arange(len(h), dtype=np.uint64)
    reach = length - ANCHOR + 1
    size = 1
    while 2 * size <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < reach:
        low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
    n = ends - starts - length + 1
    window = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    anchor = (low[window] & _AT).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:], [len(anchor)])) - 1
    at = anchor[first]
    return h[at], window[first], window[last] + length, at


def suffix_order(packed: np.ndarray, left: np.ndarray) -> np.ndarray:
    """All positions in the order of the suffixes that start there, to the end of their context; a context's end sorts by its place.

    packed: the next 8 symbols as a big-endian number, zeros from the context's end on; left: symbols up to the end.
    """
    order = np.argsort(packed)
    short = np.flatnonzero(left[order] < 8)  # those end within the 8: they differ by place
    ties = order[short]
    order[short] = ties[np.lexsort((ties, packed[ties]))]
    key = packed[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (left[order[1:]] < 8)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    slots = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))))
    depth = 8
    while len(slots):
        some = order[slots]
        key = rank[some] << 32 | rank[some + depth]
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[slots] = some
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[some] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        slots = slots[~(fresh & np.concatenate((fresh[1:], [True])))]
        depth *= 2
    return order


def _common(packed: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at x and y have in common."""
    most = np.minimum(left[x], left[y])
    same, go = np.zeros(len(x), np.int64), np.flatnonzero(most > 0)
    while len(go):
        differ = packed[x[go] + same[go]] ^ packed[y[go] + same[go]]
        more = np.where(differ == 0, 8, 0)
        for byte in range(8):
            more = np.where((differ != 0) & (more == byte) & (differ >> np.uint64(56 - 8 * byte) == 0), byte + 1, more)
        same[go] += more
        go = go[(differ == 0) & (same[go] < most[go])]
    return np.minimum(same, most)


def run_index(symbols: np.ndarray, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol of each run, first row, last row) of the Burrows-Wheeler transform; what stands before a context is a run of its own."""
    before = symbols[order - 1].astype(np.int64)
    at_start = np.zeros(len(order), bool)
    at_start[starts] = True
    before = np.where(at_start[order], -1 - order, before)
    heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
    return before[heads], heads, np.concatenate((heads[1:], [len(order)])) - 1


def longest_matches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, starts): for each byte of the texts and one end after each, how long a string from there also starts elsewhere; where texts start."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    symbols = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: the end is 0
    left = np.repeat(ends - 1, sizes) - np.arange(len(symbols))
    packed = np.zeros(len(symbols), np.uint64)
    wide = np.concatenate((symbols, np.zeros(8, np.uint8)))
    open_ = np.ones(len(symbols), bool)
    for k in range(8):
        open_ &= left > k
        packed |= np.where(open_, wide[k : k + len(symbols)], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    order = suffix_order(packed, left)
    _, heads, tails = run_index(symbols, order, starts)
    longest = np.zeros(len(symbols), np.int64)
    for rows, step in ((heads[1:], -1), (tails[:-1], 1)):  # samples at run ends, then streamed through the text
        sampled = np.zeros(len(symbols), bool)
        value = np.zeros(len(symbols), np.int64)
        sampled[order[[0 if step < 0 else -1]]] = True
        sampled[order[rows]] = True
        value[order[rows]] = _common(packed, left, order[rows], order[rows + step])
        last = np.maximum.accumulate(np.where(sampled, np.arange(len(symbols)), 0))
        longest = np.maximum(longest, value[last] - (np.arange(len(symbols)) - last))
    return longest, starts


def _ranges(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _texts(batch: pa.RecordBatch, length: int) -> tuple[bytes, list[int], np.ndarray, np.ndarray]:
    """The bytes of a batch's texts, the rows of those with `length` bytes or more, and their starts and ends."""
    text = batch["text"]
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset).astype(np.int64)
    data = text.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if text.buffers()[2] else b""
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    long = np.flatnonzero(ends - starts >= length)
    return data, long.tolist(), starts[long], ends[long]


def _long_lists(rows: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values in lists by their row, 0 to n - 1; rows ascend."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values).cast(kind, safe=False))


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(key, n): anchors of each slice of the texts, counted there."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_table()
        for batch in batches:
            for b in byte_slices(batch, "text"):
                data, _, starts, ends = _texts(b, length)
                keys, n = np.unique(contexts(np.frombuffer(data, np.uint8), starts, ends, table, length)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return docs.select("text").mapInArrow(scan, "key long, n long")


def _digests(data: bytes, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two longs of 128 bits for each context: its bytes and where its anchor stands."""
    found = b"".join(xxhash.xxh3_128_digest(data[a:z], p) for a, z, p in zip(lo.tolist(), hi.tolist(), (at - lo).tolist()))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def _candidates(docs: DataFrame, filter_, length: int) -> DataFrame:
    """One row for each text with a context whose anchor may repeat: ref, and lists of those contexts: key, c1, c2 (digest), lo, hi."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = _bytes_table(), filter_.value
        for batch in batches:
            for b in byte_slices(batch, "text"):
                data, rows, starts, ends = _texts(b, length)
                key, lo, hi, at = contexts(np.frombuffer(data, np.uint8), starts, ends, table, length)
                some = in_bloom(bits, key)
                key, lo, hi, at = key[some], lo[some], hi[some], at[some]
                c = _digests(data, lo, hi, at)
                row = np.searchsorted(ends, lo, "right")
                full = np.unique(row)
                row, base, n = np.searchsorted(full, row), starts[row], len(full)
                lists = [_long_lists(row, n, v, k) for v, k in ((key.view(np.int64), pa.int64()), (c[:, 0], pa.int64()), (c[:, 1], pa.int64()), (lo - base, pa.int32()), (hi - base, pa.int32()))]
                yield pa.RecordBatch.from_arrays([b["ref"].take(pa.array([rows[i] for i in full.tolist()], pa.int64())), *lists], ["ref", "key", "c1", "c2", "lo", "hi"])

    return docs.select("ref", "text").mapInArrow(scan, "ref binary, key array<long>, c1 array<long>, c2 array<long>, lo array<int>, hi array<int>")


def _mark(ref: Column, lo: Column) -> Column:
    """A number for a place of a text."""
    return F.xxhash64(ref).bitwiseXOR(lo.cast("long"))


def _cut(docs: DataFrame, keys, wanted, length: int) -> DataFrame:
    """The contexts whose anchor and place pass both filters: key, c1, c2, ref, lo, bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, key_bits, bits = _bytes_table(), keys.value, wanted.value
        for batch in batches:
            for b in byte_slices(batch, "text"):
                data, rows, starts, ends = _texts(b, length)
                key, lo, hi, at = contexts(np.frombuffer(data, np.uint8), starts, ends, table, length)
                row = np.searchsorted(ends, lo, "right")
                named = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in b["ref"].take(pa.array(rows, pa.int64())).to_pylist()), np.uint64, len(rows))
                some = in_bloom(key_bits, key) & in_bloom(bits, named[row] ^ (lo - starts[row]).astype(np.uint64))
                key, lo, hi, at, row = key[some], lo[some], hi[some], at[some], row[some]
                c = _digests(data, lo, hi, at)
                ref = b["ref"].take(pa.array([rows[i] for i in row.tolist()], pa.int64()))
                cut = pa.array([data[a:z] for a, z in zip(lo.tolist(), hi.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), ref, pa.array((lo - starts[row]).astype(np.int32)), cut], ["key", "c1", "c2", "ref", "lo", "bytes"])

    return docs.select("ref", "text").mapInArrow(scan, "key long, c1 long, c2 long, ref binary, lo int, bytes binary")


def _index(pieces: DataFrame, length: int) -> DataFrame:
    """(ref, start, end) of the repeated windows of the contexts that occur once, by one run-length index for each shard."""

    def mark(rows: pa.Table) -> pa.Table:
        longest, starts = longest_matches(rows["bytes"].to_pylist())
        a, z = _ranges(longest >= length)
        piece = np.searchsorted(starts, a, "right") - 1
        once = rows["once"].to_numpy()[piece]
        a, z, piece = a[once], z[once], piece[once]
        base = rows["lo"].to_numpy()[piece] - starts[piece]
        found = [rows["ref"].combine_chunks().take(pa.array(piece)), pa.array((a + base).astype(np.int32)), pa.array((z + base + length - 1).astype(np.int32))]
        return pa.Table.from_arrays(found, ["ref", "start", "end"])

    return pieces.groupBy("shard").applyInArrow(mark, "ref binary, start int, end int")


def _count_windows(pieces: DataFrame, length: int) -> DataFrame:
    """(ref, start, end) of the repeated windows of contexts that occur once, of anchors that have too many contexts for a shard."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], []]
            for row, data in enumerate(b["bytes"].to_pylist()):
                n = len(data) - length + 1
                out[0].append(b"".join(xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)))
                out[1].append(np.full(n, row))
                out[2].append(np.arange(n, dtype=np.int32))
            if out[0]:
                w, row = np.frombuffer(b"".join(out[0]), np.int64).reshape(-1, 2), np.concatenate(out[1])
                at = pa.array(row)
                start = b["lo"].take(at).to_numpy() + np.concatenate(out[2])
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), b["once"].take(at), b["ref"].take(at), pa.array(start.astype(np.int32))], ["w1", "w2", "once", "ref", "start"])

    windows = scratch(pieces.select("bytes", "lo", "ref", "once").mapInArrow(digest, "w1 long, w2 long, once boolean, ref binary, start int"), "windows")
    twice = windows.withColumn("w", F.struct("w1", "w2")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    met = attach(windows.select(F.struct("w1", "w2").alias("w"), "once", "ref", "start"), scratch(twice, "twice"), "w", "n", windows.count())
    return met.where("once").select("ref", "start", (F.col("start") + length).cast("int").alias("end"))


def text_ref(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(spans, copies): for each text that occurs once, ref and the lists whole (lo, hi of contexts), alone (lo of those that don't repeat whole) and found (start, end); and ref, n of texts that occur twice or more.

    What is removed of a text are its contexts but those alone, and what is found.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    counted = scratch(_anchors(docs, length).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "anchors")
    keys = context.broadcast(bloom_array(counted, "key"))
    candidates = scratch(_candidates(docs, keys, length), "contexts")
    each = candidates.select("ref", F.explode(F.arrays_zip("key", "c1", "c2", "lo")).alias("c")).select("ref", "c.*")
    classes = scratch(each.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("ref", "lo")).alias("first")), "classes")
    groups = classes.groupBy("key").agg(F.sum("n").alias("occurrences"), F.count("*").alias("c"), F.count_if(F.col("n") == 1).alias("edges")).where("edges > 0 and occurrences > 1")
    wanted = scratch(attach(classes, scratch(groups.select("key", "c"), "groups"), "key", "c", classes.count()), "wanted")
    some = context.broadcast(bloom_array(wanted.select(_mark(F.col("first.ref"), F.col("first.lo")).alias("mark")), "mark"))
    cut = _cut(docs, keys, some, length)
    own = wanted.select("key", "c1", "c2", "c", (F.col("n") == 1).alias("once"), F.col("first.ref").alias("ref"), F.col("first.lo").alias("lo"))
    place = ["key", "c1", "c2", "ref", "lo"]
    pieces = scratch(cut.join(own, place).dropDuplicates(place), "pieces")
    few = pieces.where(F.col("c") <= hot)
    size = few.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-size // shard_bytes))))
    found = _index(few.withColumn("shard", shard).select("shard", "bytes", "lo", "ref", "once"), length)
    if not pieces.where(F.col("c") > hot).isEmpty():
        found = found.unionByName(_count_windows(pieces.where(F.col("c") > hot), length))
    found = scratch(found, "found").groupBy("ref").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    alone = classes.where("n = 1").select("first.*").groupBy("ref").agg(F.collect_list("lo").alias("alone"))
    copies = scratch(docs.where(F.octet_length("text") >= length).groupBy("ref").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    once = candidates.select("ref", "lo", "hi").join(copies, "ref", "left_anti")
    spans = scratch(once.join(alone, "ref", "left").join(found, "ref", "left"), "spans")
    keys.unpersist()
    some.unpersist()
    discard(counted, candidates, classes, wanted, pieces)
    return spans, copies


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes that stay)."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_ref(text).alias("ref"))
    spans, copies = repeated_spans(docs, length, shard_bytes, hot)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch, "text"):
                removed, runs, kept = [], [], []
                for text, lo, hi, alone, found in zip(*[b[c].to_pylist() for c in ("text", "lo", "hi", "alone", "found")]):
                    data = text.encode()
                    gone = np.zeros(len(data) + 1, np.int32)
                    whole = ~np.isin(lo or [], alone or [])
                    np.add.at(gone, np.asarray(lo or [], np.int64)[whole], 1)
                    np.subtract.at(gone, np.asarray(hi or [], np.int64)[whole], 1)
                    for x in found or []:
                        gone[x["start"]] += 1
                        gone[x["end"]] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    removed.append(int(gone.sum()))
                    runs.append(len(_ranges(gone)[0]))
                    kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(t.encode()) for t in b["text"].to_pylist()], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    size = F.octet_length("text").cast("long")
    n = docs.count()
    light = attach(docs.select("doc_id", "ref", size.alias("n_bytes")), copies, "ref", "n", n)
    copied = light.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    short = docs.where(F.octet_length("text") < length).select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    often = copies.where(F.col("n") * 1000 >= n).select("ref")
    rest = docs.where(F.octet_length("text") >= length).join(F.broadcast(often), "ref", "left_anti")
    rest = rest.join(spans.unionByName(copies.select("ref", F.lit(True).alias("copied")), allowMissingColumns=True), "ref", "left").where("copied is null")
    return copied.unionByName(short).unionByName(rest.select("doc_id", "text", "lo", "hi", "alone", "found").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))
