"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents become token ids and an end token; longer ones are cut so that all pieces but the first are full. Pieces are
dealt at random over shards of bounded size; in each, best-fit decreasing places a piece in the open sequence with the
least room that suffices, found by a segment tree over remaining capacities in logarithmic time.

Defined results: null text is an empty document, one end token; rows that repeat are packed as often as they occur; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded_batches, scratch

#: Pieces in a shard, on average.
SHARD = 16_384
END_TEXT = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def load_encoding(name: str = "byte_bpe_50k"):
    """The public byte-level BPE vocabulary in its rank form; its ids equal those of the .json form."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_TEXT: len(ranks)})


def token_ids(encoding, text: str) -> list[int]:
    return encoding.encode(text, allowed_special={END_TEXT}) if END_TEXT in text else encoding.encode_ordinary(text)


def tokenize(docs: DataFrame, capacity: int = 1024, end_id: int = 2, name: str = "byte_bpe_50k", keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(name)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = np.asarray([*token_ids(encoding, text or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    some = ids[start : start + (capacity if piece else first)]
                    out.append((doc_id, piece, start, len(some), zlib.crc32(some.tobytes()), some.astype("i4") if keep_ids else None))
                if len(out) > 4096:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    columns = [x.split()[0] for x in PIECES.split(", ")]
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length (1 to capacity) its bin and its offset there."""
    width = 1 << capacity.bit_length()
    tree = [0] * (2 * width)  # a leaf for each remaining capacity: how many bins have it; above, sums
    bins_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for at in order.tolist():
        need = int(lengths[at])
        node = width + need
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up to the first right sibling that holds a bin
                node >>= 1
            node = node + 1 if node > 1 else 0
            while node and node < width:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        if node:
            room = node - width
            where = bins_by_room[room].pop()
            while node:
                tree[node] -= 1
                node >>= 1
        else:
            room, where, opened = capacity, opened, opened + 1
        bins[at], offsets[at] = where, capacity - room
        bins_by_room[room - need].append(where)
        node = width + room - need
        while node:
            tree[node] += 1
            node >>= 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 1024, shard: int = SHARD) -> DataFrame:
    """Add sequence_id and offset to pieces (length between 1 and capacity): gapless, at most capacity in a sequence."""
    n = pieces.count()
    shards = max(1, -(-n // shard))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(np.int64), capacity)
        rows["sequence_id"], rows["offset"] = rows["shard"].astype("int64") * (1 << 32) + bins, offsets
        return rows[[c for c in rows.columns if c != "shard"]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    fields = ", ".join(f"{c} {kind}" for c, kind in pieces.dtypes)
    return dealt.groupBy("shard").applyInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, name: str = "byte_bpe_50k") -> DataFrame:
    """Tokenise and pack all documents; one row for each piece, without its ids."""
    pieces = scratch(tokenize(docs, capacity, end_id, name, keep_ids=False).drop("ids"), "pieces")
    return pack(pieces, capacity)
