"""N-gram Jaccard self-join by size-aware heavy-light processing; returns the classes of linked documents.

Documents with equal shingle sets are one node. Small (light) sets enumerate their subsets of every size that an overlap
with a partner can have; sets that share a subset are linked to its smallest owner, which keeps every connection without
forming pairs. Large (heavy) sets scan inverted lists of prefix tokens in a global order that puts frequent tokens last.
The boundary between light and heavy is the size at which both halves together cost least, by the list entries and the
candidates that the lists of each size were measured to give.

Lists are scanned twice. First every member is compared with one pivot; the order comes from a sketch, counts of all shingles
in hash buckets. Then only nodes that share a list, within the sizes and positions of a possible link, with a node of
another component are left: their tokens are counted exactly, by a shuffle, and the lists are rebuilt in that order, in which tokens
that occur once come first, so that what documents merely quote makes no list. Candidate pairs are verified on whole sets.
Tokens are 64-bit hashes.

Defined results: null and empty texts have no shingles and are linked with nothing; rows that share a doc_id are one
document, linked by any of its texts; a null doc_id never gives its name to a class; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.shared import attach, attach_some, bloom_array, bounded_batches, byte_slices, discard, fresh, in_bloom, maybe_among, scratch

#: Largest size for which subsets may be enumerated; sets up to it are stored whole.
MAX_LIGHT = 20
#: What verifying one candidate costs, in list entries: its parity bits, texts and sets against 24 bytes of an entry.
CANDIDATE_COST = 24
#: Buckets in which shingles are counted for each row, at most, and in a row of the table that they are summed in. Counts stop at MOST.
BUCKETS_PER_ROW, MAX_BUCKETS, STRIPE, MOST = 16, 1 << 22, 1 << 14, (1 << 15) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the hash of every k-word window of the texts, and where each text's windows end.

    A-Z are lowered and words are what ASCII white space parts. A text of fewer words makes one window, of none, no window.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.string())))
    flat = words.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))[full]
    named = flat.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh64_intdigest, named.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(named.dictionary))
    w = known[named.indices.to_numpy(zero_copy_only=False)[full]] if len(known) else np.empty(0, np.uint64)
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    n_windows = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    ends = np.cumsum(n_windows)
    starts = np.repeat(first - (ends - n_windows), n_windows) + np.arange(ends[-1] if len(ends) else 0)
    length = np.repeat(np.minimum(n, k), n_windows)
    h = length.astype(np.uint64)
    for j in range(k):
        on = length > j
        if on.all():
            h = _mix(h * _ODD + w[starts + j])
        elif on.any():
            h[on] = _mix(h[on] * _ODD + w[starts[on] + j])
    return h, ends


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word windows of each text."""
    h, ends = window_hashes(texts, k)
    return [np.unique(h[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def subsets_of(n: int, percent: int) -> int:
    """Number of subsets that a light set of n shingles enumerates."""
    total, c = 0, 1
    for out in range(n - least_overlap(n, percent) + 1):
        total, c = total + c, c * (n - out) // (out + 1)
    return total


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """How often, modulo 2, tokens fall on each of 512 bits; on 4096 for large sets. 8 or 64 longs."""
    width = 512 if len(tokens) <= 800 else 4096
    odd = np.bincount((tokens >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_difference(x: Column, y: Column) -> Column:
    """A lower bound for the number of tokens that one of two sets has and the other hasn't, by their parity bits."""
    fold = lambda p: F.when(F.size(p) == 8, p).otherwise(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda a, m: a.bitwiseXOR(F.get(p, 8 * m + j)))))
    same = F.size(x) == F.size(y)
    bits = F.zip_with(F.when(same, x).otherwise(fold(x)), F.when(same, y).otherwise(fold(y)), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0), lambda a, b: a + b)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows).view(np.int64) if len(rows) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _counts(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles of all documents, counted in hash buckets, which grow with the rows up to MAX_BUCKETS; two bytes each reach the driver."""
    stripe, most = STRIPE, MOST
    buckets = min(MAX_BUCKETS, 1 << max(14, (BUCKETS_PER_ROW * docs.count() - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int16)
        for batch in batches:
            for b in byte_slices(batch, "text"):
                h, _ = window_hashes(b["text"], k)
                at, n = np.unique((h & np.uint64(buckets - 1)).astype(np.int32), return_counts=True)
                total[at] = np.minimum(total[at] + n, most)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, buckets + 1, stripe), pa.int32()), pa.array(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets // stripe)), rows], ["stripe", "counts"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(stripe, np.int64)
        for part in rows["counts"]:
            total += part
        return pd.DataFrame({"stripe": [key[0]], "counts": [np.minimum(total, most).astype(np.int16)]})

    parts = docs.select("text").mapInArrow(count, "stripe long, counts array<short>")
    total = np.zeros(buckets, np.uint16)
    for r in parts.groupBy("stripe").applyInPandas(add, "stripe long, counts array<short>").toLocalIterator():
        total[r.stripe * stripe : (r.stripe + 1) * stripe] = r.counts
    return total


def _sets(docs: DataFrame, k: int, percent: int, counts) -> DataFrame:
    """doc_id, n, key (hash of the whole set), parity, tokens: prefix in the order of the sketch, or the whole set up to MAX_LIGHT."""
    whole = MAX_LIGHT

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = counts.value
        buckets = len(weight)
        for batch in batches:
            for b in byte_slices(batch, "text"):
                sets = shingle_sets(b["text"], k)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                kept = []
                for s in sets:
                    s = s[np.lexsort((s, weight[(s & np.uint64(buckets - 1)).astype(np.int64)]))]
                    kept.append(s if len(s) <= whole else s[: prefix_length(len(s), percent)])
                columns = [b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), _lists(kept), _lists([parity_bits(s) for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "tokens", "parity"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, n long, key binary, tokens array<long>, parity array<long>")


def _light_pairs(nodes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Pairs (a, b) of light nodes that share a subset large enough to link them."""

    def enumerate_subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                sigs, sizes, ns, ids = [], [], [], []
                for node, n, tokens in b.iloc[at : at + 200][["node", "n", "tokens"]].itertuples(index=False):
                    t = np.sort(np.asarray(tokens, np.int64))
                    for size in range(least_overlap(n, percent), n + 1):
                        for some in combinations(range(n), size):
                            sigs.append(xxhash.xxh64_intdigest(t[list(some)].tobytes(), size) - (1 << 63))
                            sizes.append(size)
                    ids += [node] * (len(sigs) - len(ids))
                    ns += [n] * (len(sigs) - len(ns))
                yield pd.DataFrame({"sig": sigs, "size": sizes, "n": ns, "node": ids}, dtype="int64")

    rows = scratch(nodes.where(F.col("n") <= boundary).mapInPandas(enumerate_subsets, "sig long, size long, n long, node long"), "subsets")
    first = rows.groupBy("sig").agg(F.min("n").alias("least"), F.min_by("node", F.col("n") * F.lit(1 << 40) + F.pmod("node", F.lit(1 << 40))).alias("owner"), F.count("*").alias("c")).where("c > 1")
    met = attach(rows, scratch(first, "owners"), "sig", "c", rows.count())
    enough = (F.col("node") != F.col("owner")) & (100 * F.col("size") >= percent * (F.col("n") + F.col("least") - F.col("size")))
    return met.where(enough).select(F.col("node").alias("a"), F.col("owner").alias("b")).distinct()


def _may_link(na: str, ia: str, nb: str, ib: str, percent: int) -> Column:
    """Size and position filters for a pair whose first common token stands at ia and ib."""
    na, ia, nb, ib = F.col(na), F.col(ia), F.col(nb), F.col(ib)
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return sizes & ((1 + F.least(na - ia - 1, nb - ib - 1)) * (100 + percent) >= percent * (na + nb))


def _size_class(n: Column, percent: int) -> Column:
    return F.floor(F.log(n) / float(np.log(100 / percent)) + 1e-9)


def _roles(postings: DataFrame, percent: int) -> DataFrame:
    """Rows of postings (token, n, i, ...) as the smaller of a pair, in the class of their size, and as the larger one, in the classes of the sizes of its partners; adds smaller and group.

    A first common token at position i leaves n - i tokens for the overlap, which bounds the sizes of the partners.
    """
    n, left = F.col("n"), F.col("n") - F.col("i")
    smallest, largest = F.ceil(percent * n / 100), F.least(n, F.floor(left * (100 + percent) / percent - n))
    group = F.xxhash64("token", "class").alias("group")
    small = postings.where(left * (100 + percent) >= 2 * percent * n).withColumn("class", _size_class(n, percent))
    large = postings.where(largest >= smallest).withColumn("class", F.explode(F.sequence(_size_class(smallest, percent), _size_class(largest, percent))))
    return small.select("*", F.lit(True).alias("smaller"), group).unionByName(large.select("*", F.lit(False).alias("smaller"), group)).drop("class")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sizes and parity bits don't rule the similarity out."""
    first = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    second = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    n = F.col("na") + F.col("nb")
    most = n - 2 * F.ceil(percent * n / (100 + percent))
    return pairs.join(first, "a").join(second, "b").where(least_difference(F.col("pa"), F.col("pb")) <= most).select("a", "b")


def _rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids (a scratch table). A Bloom filter keeps most other texts from the shuffle."""
    return maybe_among(docs, ids, "doc_id", "maybe").where("maybe").drop("maybe").join(ids, "doc_id", "left_semi")


def _verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of document ids, those whose whole shingle sets are similar enough."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([b["doc_id"], _lists(shingle_sets(b["text"], k))], ["node", "tokens"])

    ids = scratch(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = scratch(_rows_of(docs.select("doc_id", "text"), ids).mapInArrow(tokens, "node long, tokens array<long>"), "verify")
    x, y = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("both"))
    links = scratch(met.where(100 * F.col("both") >= percent * (F.col("nx") + F.col("ny") - F.col("both"))).select("a", "b").distinct(), "links")
    discard(ids, sets)
    return links


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (hi, lo) is either a centre or has its centre as its only neighbour."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("low")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("low")))).alias("x")).groupBy("x.node").agg(F.sum("x.low").alias("up"), F.min("x.low").alias("low"))
    return ends.where("up > 1 or up = 1 and low = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable. Alternating large and small stars, until only stars are left."""

    def least_neighbour(e: DataFrame) -> DataFrame:
        return scratch(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "least")

    e = scratch(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while not _are_stars(e):
        both = e.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("x")).select("x.*")
        n = 2 * e.count()
        least = least_neighbour(both)
        large = scratch(attach(both, least, "u", "c", n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "star")
        other = least_neighbour(large)
        small = attach(large, other, "u", "c", n).select(F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")))).alias("x")).select("x.*")
        after = scratch(small.where("hi != lo").distinct(), "edges")
        discard(e, least, large, other)
        e = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())


def boundary_by_cost(nodes: DataFrame, shared: DataFrame, percent: int) -> int:
    """The size up to MAX_LIGHT up to which enumerating costs less than scanning; on a tie, the larger one.

    Enumerating costs a row for each subset. Scanning costs an entry for each prefix token, and CANDIDATE_COST for each
    entry of a list (shared) that other nodes are in too.
    """
    have = {r.n: r["count"] for r in nodes.where(F.col("n") <= MAX_LIGHT).groupBy("n").count().collect()}
    met = {r.n: r["count"] for r in shared.where(F.col("n") <= MAX_LIGHT).groupBy("n").count().collect()}
    saved, best, boundary = 0, 0, 0
    for n in range(1, MAX_LIGHT + 1):
        saved += have.get(n, 0) * (prefix_length(n, percent) - subsets_of(n, percent)) + CANDIDATE_COST * met.get(n, 0)
        if saved >= best:
            best, boundary = saved, n
    return boundary


def _apart(shared: DataFrame, classes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """The nodes that share a list with a node of another component that they could be linked with, as (node, component)."""
    placed = shared.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = scratch(_roles(placed, percent).select("group", "smaller", "node", "component"), "roles")
    own = [f(F.when(side, F.col("component"))).alias(name) for side, s in ((F.col("smaller"), "small"), (~F.col("smaller"), "large")) for f, name in ((F.min, f"{s}_min"), (F.max, f"{s}_max"))]
    groups = rows.groupBy("group").agg(*own, F.count("*").alias("c")).where("least(small_min, large_min) < greatest(small_max, large_max) and small_min is not null and large_min is not null")
    groups = scratch(groups, "groups")
    met = attach_some(rows, groups, "group", "c", rows.count())
    c = F.col("component")
    other = F.when(F.col("smaller"), (F.col("large_min") != c) | (F.col("large_max") != c)).otherwise((F.col("small_min") != c) | (F.col("small_max") != c))
    found = scratch(met.where(other).select("node", "component").distinct(), "apart")
    discard(rows, groups)
    return found


def _repeated_postings(docs: DataFrame, apart: DataFrame, k: int, percent: int, counts) -> DataFrame:
    """Postings (token, node, n, i) of the nodes apart, of tokens that two or more of these nodes have, in an order in which all others come first.

    Tokens are counted by a shuffle of nothing but tokens. Those counted twice or more make a Bloom filter, and the order is by whether a token
    passes it, then by the sketch, then by the token: the same for all nodes, so any links' first common token is in both prefixes. Tokens that
    occur once make no list, so most nodes that merely quote the same passage meet nobody here.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([b["doc_id"], _lists(shingle_sets(b["text"], k))], ["node", "tokens"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bits = counts.value, repeated.value
        buckets = len(weight)
        for b in batches:
            for node, tokens in zip(b["node"].to_pylist(), b["tokens"]):
                t = tokens.values.to_numpy().view(np.uint64)
                again = in_bloom(bits, t)
                order = np.lexsort((t, weight[(t & np.uint64(buckets - 1)).astype(np.int64)], again))[: prefix_length(len(t), percent)] if len(t) else np.empty(0, np.int64)
                i = np.flatnonzero(again[order])
                columns = [pa.array(t[order[i]].view(np.int64)), *[pa.array(np.full(len(i), x, np.int64)) for x in (node, len(t))], pa.array(i.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "node", "n", "i"])

    ids = scratch(apart.select(F.col("node").alias("doc_id")), "ids")
    found = scratch(_rows_of(docs.select("doc_id", "text"), ids).mapInArrow(tokens, "node long, tokens array<long>"), "tokens")
    often = scratch(found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"), "often")
    repeated = docs.sparkSession.sparkContext.broadcast(bloom_array(often, "token"))
    postings = scratch(found.mapInArrow(place, "token long, node long, n long, i int"), "placed")
    repeated.destroy()
    discard(ids, found, often)
    return postings


def _same_document(sets: DataFrame, owners: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that hold different texts of one doc_id."""
    h = F.xxhash64("key")
    several = sets.where("key is not null and doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("least"), F.max(h).alias("most")).where("least < most").select("doc_id")
    met = scratch(sets.join(several, "doc_id", "left_semi").select("doc_id", "key").distinct().join(owners, "key").select("doc_id", "node"), "several")
    return met.join(met.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable by links of that similarity)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = docs.sparkSession.sparkContext.broadcast(_counts(docs, k))
    sets = scratch(_sets(docs, k, percent, counts), "sets")
    n_rows = sets.count()
    one = [F.min_by(c, "doc_id").alias(c) for c in ("n", "tokens", "parity")]
    nodes = scratch(sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), *one), "nodes")
    owners = nodes.select("key", "node", "copies")
    nodes = nodes.where("node is not null")
    prefix = F.expr(f"slice(tokens, 1, cast(n - ceil({percent} * n / 100) + 1 as int))")
    postings = nodes.select("node", "n", F.posexplode(prefix).alias("i", "token"))
    lists = scratch(postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "lists")
    total = lists.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    shared = scratch(attach_some(postings, lists, "token", "c", total), "postings")
    discard(lists)
    boundary = boundary_by_cost(nodes, shared, percent)
    light = _light_pairs(nodes, boundary, percent)
    shared = shared.where(F.col("n") >= least_overlap(boundary + 1, percent))
    pivots = scratch(shared.groupBy("token").agg(F.min("node").alias("pivot"), F.min_by("n", "node").alias("pn"), F.min_by("i", "node").alias("pi"), F.count("*").alias("members")), "pivots")
    met = attach(shared, pivots, "token", "members", total)
    some_heavy = F.greatest("n", "pn") > boundary
    first = met.where((F.col("node") != F.col("pivot")) & some_heavy & _may_link("n", "i", "pn", "pi", percent)).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    first = scratch(first.union(light).distinct(), "pairs")
    links = _verify(docs, scratch(_possible(first, nodes, percent), "possible"), k, percent)
    apart = _apart(shared.select("token", "node", "n", "i"), scratch(components(links), "classes"), boundary, percent)
    listed = _roles(_repeated_postings(docs, apart, k, percent, counts).join(apart, "node"), percent)
    counts.destroy()
    sides = [listed.where("smaller" if x == "a" else "not smaller").select("group", *[F.col(c).alias(f"{c}_{x}") for c in ("token", "node", "n", "i", "component")]) for x in "ab"]
    near = (F.col("token_a") == F.col("token_b")) & (F.col("component_a") != F.col("component_b")) & (F.greatest("n_a", "n_b") > boundary) & _may_link("n_a", "i_a", "n_b", "i_b", percent)
    second = sides[0].join(sides[1], "group").where(near).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    more = _verify(docs, scratch(_possible(scratch(second, "pairs"), nodes, percent), "possible"), k, percent)
    classes = components(links.union(more).union(_same_document(sets, owners)))
    named = owners.join(classes, "node", "left").select("key", "copies", F.coalesce("component", "node").alias("component_id"))
    known = attach(sets.where("key is not null"), scratch(named, "named"), "key", "copies", n_rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return known.union(sets.where("key is null").select("doc_id", "n", "doc_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that give their class its name, and those without a doc_id: one document of each class stays.

    Rows that a Bloom filter of the others clears pass straight on; only the rest shuffles with its texts.
    """
    named = jaccard_classes(docs, k, percent).where("doc_id != component_id").select("doc_id").distinct()
    named, flag = scratch(named, "dropped"), fresh(docs, "__maybe")
    flagged = maybe_among(docs, named, "doc_id", flag)
    rest = flagged.where(F.col(flag)).drop(flag).join(named, "doc_id", "left_anti")
    return flagged.where(~F.col(flag)).select(*docs.columns).unionByName(rest.select(*docs.columns))
