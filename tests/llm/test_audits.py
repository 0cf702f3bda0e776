"""Filter audit, source audit and repeat index against brute force, on the smallest tables and on odd rows."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import filter_audit, repeat_index, shared, source_audit

DIR = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "a1b2" * 5_000 + " x@" + "b." * 5_000 + "c"
PASSAGE = "".join(chr(97 + (i * i + 7 * i) % 26) for i in range(260))
ODD = [
    (1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "one two three four five six", "en", None),
    (4, " \n\t ", "xx", "b"), (5, LONG, "en", "a"), (6, "<|endoftext|> 😀 é", None, "b"), (7, "One  two\nthree four five six", "en", ""), (None, None, None, None), (8, "YOU idiot# " * 30, "en", "b"), (9, "é" * 100 + PASSAGE + "é" * 50, "", "c"),
    (10, PASSAGE[:220] + "z" * 300 + PASSAGE[40:], "en", "c"), (11, PASSAGE[:199], "de", "c"), (12, LONG[:1000], "en", "b"), (13, "Z" * 200, "de", "a"), (14, "Z" * 199, "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ref string, lo string, n string, part string, fails string, term string, value string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "r", "l", "n", "p", "f", "t", "v") for r in ODD], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 0, 1), (8, 1, 1), (99, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.select("doc_id", "text", "lang", "source").collect()]


# --- filters ------------------------------------------------------------------------------------------------------------


def failures(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        caps, signs = len(re.findall("[A-Z]", t)), re.search(r"[#$%&*|]", t)
        fails = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * caps > 3 * len(t) else "") + ("D" if signs else "") + ("E" if i is not None and i > least[t] else "")
        yield i, lang or "", fails


def audited(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = list(failures(rows))
    out = {}
    for part in {p for _, p, _ in judged}:
        own = [(i, f) for i, p, f in judged if p == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                redundant = sum(f in x and any(y in x for y in order[: step - 1]) for _, x in own)
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x == f for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(removed_by[f])
    return out


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_filters_by_every_order(request, spark, labels, table):
    rows = request.getfixturevalue(table)
    known = labels if table == "odd" else spark.read.parquet(f"{DIR}/labels.parquet")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit_filters(rows, known).collect()}
    assert got == audited(rows_of(rows), [(r.doc_id, r.quality, r.toxic) for r in known.collect()])
    assert filter_audit.audit_filters(rows.limit(0), known.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab AZ\n\t#é😀\x00 |"), max_size=30), min_size=1, max_size=6))
def test_transducer_counts(texts):
    encoded = [t.encode() for t in texts]
    got = filter_audit.text_counts(np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([len(b) for b in encoded]), filter_audit.transition_table())
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert [int(got[k][i]) for k in ("words", "distinct", "code_points", "capitals")] == [len(w), len(set(w)), len(t), len(re.findall("[A-Z]", t))]
        assert got["symbols"][i] == len(re.findall(r"[#$%&*|]", t))


def test_words_are_distinct_whatever_their_hashes():
    """One hash for all words: only the bytes tell them apart."""
    words = [b"aa", b"ab", b"aa", b"b", b"ab", b"aab", b"b"]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for rows, want in (([0] * 7, [1, 1, 0, 1, 0, 1, 0]), ([0, 0, 1, 1, 1, 1, 2], [1, 1, 1, 1, 1, 1, 1])):
        assert filter_audit.distinct_spans(data, starts, ends, np.array(rows), np.zeros(7, np.uint64)).astype(int).tolist() == want


# --- sources ------------------------------------------------------------------------------------------------------------


def compared(rows, ranks=200, least=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))) for _, t, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        own = [x for x in terms if x[0] == lang]
        df = Counter(t for *_, w in own for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter(t for _, x, w in own if x == s for t in w if df[t] >= least) for s in {x[1] for x in own}}
        every = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, of = p(every), {s: p(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = sorted((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            found = sorted((-f(of[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and of[s][t] > q[t])[:ranks]
            out += [(lang, s, part, item.decode(), -v, r) for part, some in (("pair", pairs), ("term", found)) for r, (v, item) in enumerate(some, 1)]
    return sorted(out)


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_sources_by_recount(request, table):
    rows = request.getfixturevalue(table)
    assert sorted(map(tuple, source_audit.audit_sources(rows).collect())) == compared(rows_of(rows))
    assert source_audit.audit_sources(rows.limit(0)).count() == 0


def test_sources_of_ties_and_few_ranks(spark, monkeypatch):
    """Many terms of equal counts, more than there are ranks; partial sums that are handed on after every text."""
    monkeypatch.setattr(source_audit, "HELD_TERMS", 0)
    words = [f"{a}{b}é" for a in "abcdefgh" for b in "xyz"]
    rows = [(i, " ".join(words[k] for k in range(24) if (k * (i % 3 + 1)) % 5 < 3) + f" Only{i % 4}", "en", f"s{i % 3}") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    for ranks in (3, 7, 200):
        assert sorted(map(tuple, source_audit.audit_sources(df, ranks).collect())) == compared(rows, ranks)


def test_probabilities_are_exact(spark):
    big = spark.createDataFrame([(10**12, 3 * 10**12 + 7, 10**6), (0, 0, 1), (10**15, 10**15, 10**9)], "c long, n long, v long")
    got = [tuple(r) for r in big.select("c", "n", "v", source_audit.probability(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert all(p == 1 + 10**9 * (c + 1) // (n + v) for c, n, v, p in got)


# --- repeats ------------------------------------------------------------------------------------------------------------


def without_repeats(rows, length=200):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for (doc_id, *_), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        yield (doc_id, len(b), int(gone.sum()), int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))), hashlib.sha256(kept).hexdigest())


def digests(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_repeats_by_brute_force(request, table):
    rows = request.getfixturevalue(table)
    want = sorted(without_repeats(rows_of(rows)), key=str)
    assert digests(repeat_index.remove_repeats(rows)) == want and sum(r[2] for r in want) > 0
    assert repeat_index.remove_repeats(rows.limit(0)).count() == 0


@pytest.mark.parametrize("block", [200, 333, 1000])
def test_contexts_of_long_texts_in_pieces(monkeypatch, block):
    """Windows of a text that is read in pieces have the anchors that they have in one piece, each in one context."""
    rng = np.random.default_rng(block)
    data = rng.integers(97, 100, 4000, np.uint8)
    starts, ends = np.array([0, 2300]), np.array([2100, 4000])
    named = lambda: {i: (k, p) for k, a, z, p in zip(*repeat_index.contexts(data, starts, ends, repeat_index._bytes_table())) for i in range(a, z - 199)}
    whole = named()
    monkeypatch.setattr(repeat_index, "BLOCK", block)
    assert named() == whole and len(whole) == 1901 + 1501
    assert all(len(x) == 0 for x in repeat_index.contexts(data, starts[:0], ends[:0], repeat_index._bytes_table()))


def test_repeats_in_small_shards_and_hot_anchors(spark):
    """Pieces of one base at all offsets, a passage between many different texts, runs of one character; indexed in tiny shards, and counted as windows."""
    rng = np.random.default_rng(3)
    letters = lambda n, a="abcdefgh ": "".join(rng.choice(list(a), n))
    base = letters(2500)
    texts = [base[i : i + n] for i, n in zip(rng.integers(0, 2300, 30), rng.integers(150, 700, 30))] + ["a" * 900, "ab" * 300, "é" * 400, base]
    texts += [letters(int(n)) + base[500:740] + letters(int(n) // 2) for n in rng.integers(0, 300, 40)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(6)
    want = sorted(without_repeats(rows), key=str)
    for hot, shard_bytes in ((2048, 1 << 12), (3, 1 << 20)):
        assert digests(repeat_index.remove_repeats(df, shard_bytes=shard_bytes, hot=hot)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=25), min_size=1, max_size=6))
def test_longest_matches_by_search(texts):
    encoded = [t.encode() for t in texts]
    longest, starts = repeat_index.longest_matches(encoded)
    every = [(k, i) for k, b in enumerate(encoded) for i in range(len(b))]
    for k, i in every:
        own = encoded[k][i:]
        best = max((next((m for m in range(min(len(own), len(b) - j)) if own[m] != b[j + m]), min(len(own), len(b) - j)) for x, b in enumerate(encoded) for j in range(len(b)) if (x, j) != (k, i)), default=0)
        assert longest[starts[k] + i] == best


def test_run_index_is_the_transform(spark):
    """Runs spelled out are the symbols before the sorted suffixes, and both ends of a run are sampled."""
    text = b"abracadabra" * 3
    symbols = np.frombuffer(text + b"\xff", np.uint8) + np.uint8(1)
    order = np.array(sorted(range(len(symbols)), key=lambda i: symbols[i:].tobytes()))
    of, heads, tails = repeat_index.run_index(symbols, order, np.array([0]))
    before = np.where(order == 0, -1, symbols[order - 1].astype(int))
    assert np.repeat(of, tails - heads + 1).tolist() == before.tolist() and len(of) < len(symbols) // 2


def test_contexts_name_equal_windows_alike():
    """Every window lies in one context, and equal windows of different texts have equal anchors at equal places."""
    rng = np.random.default_rng(5)
    shared_part = rng.integers(97, 105, 700, np.uint8)
    parts = [np.concatenate((rng.integers(97, 105, n, np.uint8), shared_part, rng.integers(97, 105, m, np.uint8))) for n, m in ((0, 50), (333, 0), (120, 90))]
    data, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    key, lo, hi, at = repeat_index.contexts(data, starts, ends, repeat_index._bytes_table())
    windows = [(k, i) for k, (a, z) in enumerate(zip(starts, ends)) for i in range(a, z - 199)]
    assert [i for a, z in zip(lo, hi) for i in range(a, z - 199)] == [i for _, i in windows]
    named = {}
    for x, p, a, z in zip(key, at, lo, hi):
        for i in range(a, z - 199):
            assert named.setdefault(data[i : i + 200].tobytes(), (x, p - i)) == (x, p - i)


def test_a_full_filter_lets_more_through_but_none_back(spark, monkeypatch):
    """Bloom filters of bounded size: as rows and as an array, far beyond what they were made for, they have no false negative."""
    keys = shared.scratch(spark.range(20_000).select(F.xxhash64("id").alias("h")), "keys")
    some = spark.range(40_000).select("id", F.xxhash64("id").alias("h"))
    for blocks in (1 << 10, 1 << 19):
        monkeypatch.setattr(shared, "MAX_BROADCAST_BLOCKS", blocks)
        monkeypatch.setattr(shared, "MAX_ARRAY_BLOCKS", blocks)
        flagged = shared.maybe_among(some, keys, "h", "maybe").groupBy((F.col("id") < 20_000).alias("there")).agg(F.count_if("maybe").alias("n")).collect()
        n = {r.there: r.n for r in flagged}
        bits = shared.bloom_array(keys, "h")
        passed = shared.in_bloom(bits, np.array([r.h for r in some.collect()], np.int64).view(np.uint64))
        assert n[True] == 20_000 and passed[:20_000].all() and len(bits) <= blocks
        assert n[False] < (12_000 if blocks == 1 << 10 else 1_000) and passed[20_000:].sum() < (12_000 if blocks == 1 << 10 else 1_000)
