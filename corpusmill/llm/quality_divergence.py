"""Quality rules by distribution divergence.

Every document gives two histograms: of its bytes by character class, and of its words by common word (with one bin for
all others). Their sums over the sound documents of a language are that language's references. A document is dropped if
the Jensen-Shannon distance of a histogram to the reference of its language is too large for its length; short documents
are not judged by a histogram that they can't fill.

Defined results: null text has no words and fails the base rules; null is a language of its own; a document whose language
has no sound document is judged by the base rules alone; rows that repeat are judged each; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded_batches, scratch

#: Common words of English, French, German and Spanish. Fixed values.
COMMON = (
    "the of and to in is that it for was on are with as be this by at from or have an not but had his they which one you were her all she there would their we him been has when who will more no if out so "
    "de la le et les des en un du une que est pour qui dans par plus au pas sur ne se ce il sont avec son aux "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "el los se las una por con para como su al lo más pero sus o fue ha si sin sobre este ya entre cuando todo esta"
).split()
WORDS = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON))}
CLASS_NAMES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "non_ascii")
_SPACES, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"


def _byte_classes() -> np.ndarray:
    table = np.full(256, CLASS_NAMES.index("other"))
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", _SPACES), ("stop", ".,;:!?"), ("symbol", _SYMBOLS + "@=+_~^{}[]/\\")):
        table[[ord(c) for c in chars]] = CLASS_NAMES.index(name)
    table[0x80:] = CLASS_NAMES.index("non_ascii")
    return table


_CLASS_OF = _byte_classes()


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window that occurs at least twice."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    tri = ((h[:-2] * a) ^ (h[:-2] >> np.uint64(29))) * b + ((h[1:-1] * b) ^ (h[1:-1] >> np.uint64(31))) * a + h[2:]
    _, inverse, counts = np.unique(tri, return_inverse=True, return_counts=True)
    twice = counts[inverse] >= 2
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def text_features(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, histogram of classes, histogram of common words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = Counter(x for x in text.split("\n") if x.strip(_SPACES))
    classes = np.bincount(_CLASS_OF, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=len(CLASS_NAMES)).astype(np.int64)
    bare = Counter(data.lower().translate(None, b".,;:!?\"'()[]|#*$%&<>").split())
    common = np.zeros(len(WORDS) + 1, np.int64)
    for w in WORDS.keys() & bare.keys():
        common[WORDS[w]] = bare[w]
    common[-1] = sum(bare.values()) - common.sum()
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), sum(lines.values()) - len(lines), repeated_words(words), classes, common)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) of rows of p and q; a row without mass is 0 away."""
    ps, qs = p.sum(-1, keepdims=True), q.sum(-1, keepdims=True)
    ok = (ps[..., 0] > 0) & (qs[..., 0] > 0)
    p, q = p / np.where(ps > 0, ps, 1), q / np.where(qs > 0, qs, 1)
    m = (p + q) / 2

    def kl(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    return np.where(ok, np.sqrt(np.maximum(0, (kl(p) + kl(q)) / 2)), 0.0)


_FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"


def document_features(docs: DataFrame) -> DataFrame:
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _FEATURES.split(", ")]
        for b in batches:
            yield pd.DataFrame([(i, lang, *text_features(t or "")) for i, lang, t in zip(b["doc_id"], b["lang"], b["text"])], columns=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInPandas(features, _FEATURES)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def language_references(features: DataFrame) -> DataFrame:
    """One row for each language: the summed histograms of its sound documents. Long sums, combined before the shuffle."""
    bins = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in (("classes", len(CLASS_NAMES)), ("common", len(WORDS) + 1)) for i in range(n)]
    t = features.where(~F.col("base_failed")).groupBy("lang").agg(*bins)
    return t.select("lang", *[F.array(*[x for x in t.columns if x.startswith(c)]).alias(f"ref_{c}") for c in ("classes", "common")])


def quality_verdicts(docs: DataFrame, max_class: float = 0.2, max_common: float = 0.18, slack: float = 1.6, min_words: int = 50, min_common_words: int = 80) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, both distances and kept.

    A distance may exceed its limit by slack / sqrt(n_words), what chance alone does to short texts.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].copy()
            for c in ("classes", "common"):
                there = b[f"ref_{c}"].notna()
                zero = np.zeros(len(b[c].iloc[0]) if len(b) else 1)
                out[f"{c}_distance"] = js_distance(np.stack([np.asarray(x, float) for x in b[c]]), np.stack([np.asarray(x, float) if t else zero for x, t in zip(b[f"ref_{c}"], there)])) if len(b) else []
            n = np.maximum(1, b["n_words"].to_numpy())
            far = (out["classes_distance"] > max_class + slack / np.sqrt(n) / 4) | (n >= min_common_words) & (out["common_distance"] > max_common + slack / np.sqrt(n))
            out["kept"] = ~b["base_failed"].to_numpy(bool) & ~far
            yield out

    bounded_batches(docs.sparkSession)
    features = scratch(document_features(docs).withColumn("base_failed", base_failed(min_words)), "features")
    references = scratch(language_references(features), "references")
    joined = features.join(references.withColumnRenamed("lang", "ref_lang"), F.col("lang").eqNullSafe(F.col("ref_lang")), "left").drop("ref_lang", "lang")
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, classes_distance double, common_distance double, kept boolean"
    return joined.mapInPandas(judge, schema)
