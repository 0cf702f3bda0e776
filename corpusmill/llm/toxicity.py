"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers are composed. The lexicon maps words to the symbols insult (with a weight), threat, target, negation and report.
Three machines read these symbols and weigh insults and threats: one raises them where a target stands anywhere in the
clause, one lowers those that follow a negation, one lowers all where a report stands anywhere, also after them ("you are
an idiot, he said"). Their product is the grammar; a clause scores the weight of its best accepting path. Clauses end at a
full stop, semicolon or line end; commas and colons stay inside, so reports and negations act across them. In a text without insults
a threat counts only in a clause that also names a target ("kill you", not "kill the process"). The scores of a document's
matched clauses, never its isolated words, are its features: their sum, the highest, how much there is for its length. A
logistic function, fitted to labelled documents, turns them into a score from 0 to 1.

Insult words are learned: words, and beginnings of words, that toxic documents of a bounded sample hold far more often than
others. The sample bound is the parameter max_labels; every term of the sample is looked at. Everything else covers all rows.

Defined results: null and empty texts have no clauses and get the lowest score; labels that are null, or repeat a document,
are left out or count once; of texts that share a labelled doc_id, the first by code point is learned from; without labels
of both kinds only the fixed words score; rows that repeat are scored each; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded_batches, scratch

#: Closed classes of words in English, French, German and Spanish, and seed insults. Fixed values.
TARGETS = frozenset("you your yours u he him his she her they them their tu toi ton ta vous votre du dich dir dein ihr euch sie usted ustedes tú te ti vosotros".split())
NEGATIONS = frozenset("not never no isn't aren't don't doesn't didn't won't wasn't pas jamais ne nicht kein keine nie nunca jamás".split())
REPORTS = frozenset("said says saying wrote writes claimed claims reported quoted quote called alleged dit écrit déclaré sagte sagt schrieb behauptet dijo dice escribió".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn murder attack tuer frapper töten schlagen matar golpear".split())
SEED_INSULTS = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown".split())

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:,|\n]")
_ENDS = frozenset(".!?;|\n")
STEMS = (6, 5, 4)
SYMBOLS = ("insult", "threat", "target", "negation", "report")
#: The weight of a threat; sampled labels may hold too few threats to learn one.
THREAT_WEIGHT = 3.0


@dataclass(frozen=True)
class Machine:
    """A weighted machine over symbols: (state, symbol) to (next state, factor of an insult or threat read there), or to None, where the path ends. A pair without an arc keeps the state, with factor 1."""

    starts: tuple
    finals: frozenset
    arcs: dict

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, 1.0))


def anywhere(symbol: str, insult: float, threat: float) -> Machine:
    """Insults and threats of a clause that holds the symbol anywhere get these factors. A path guesses at the start whether it does."""
    arcs = {("without", symbol): None, ("awaited", symbol): ("met", 1.0)}
    for state in ("awaited", "met"):
        arcs |= {(state, "insult"): (state, insult), (state, "threat"): (state, threat)}
    return Machine(("without", "awaited"), frozenset(("without", "met")), arcs)


def following(symbol: str, insult: float, threat: float) -> Machine:
    """The first insult or threat after the symbol gets its factor."""
    return Machine(("plain",), frozenset(("plain", "open")), {("plain", symbol): ("open", 1.0), ("open", "insult"): ("plain", insult), ("open", "threat"): ("plain", threat)})


def compose(a: Machine, b: Machine) -> Machine:
    """The machine that reads with both at once: states are pairs, factors multiply, a path ends where one of them ends."""
    states = [{*m.starts, *m.finals, *(s for s, _ in m.arcs), *(x[0] for x in m.arcs.values() if x)} for m in (a, b)]
    arcs = {}
    for x in states[0]:
        for y in states[1]:
            for symbol in SYMBOLS:
                p, q = a.step(x, symbol), b.step(y, symbol)
                if p is None or q is None:
                    arcs[(x, y), symbol] = None
                elif (p[0], q[0]) != (x, y) or p[1] * q[1] != 1.0:
                    arcs[(x, y), symbol] = ((p[0], q[0]), p[1] * q[1])
    return Machine(tuple((x, y) for x in a.starts for y in b.starts), frozenset((x, y) for x in a.finals for y in b.finals), arcs)


PARTS = (anywhere("target", 1.25, 1.25), following("negation", 0.6, 0.2), anywhere("report", 0.7, 0.3))
GRAMMAR = compose(compose(PARTS[0], PARTS[1]), PARTS[2])


@dataclass
class Lexicon:
    """Learned weights: of whole words that the sample knows, else of their beginnings."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_INSULTS, 3.0))
    stems: dict[str, float] = field(default_factory=dict)
    model: tuple[float, ...] = (-3.5, 1.0, 0.5, 0.5)

    def weight(self, word: str) -> float:
        known = self.words.get(word)
        if known is not None:
            return known
        for n in STEMS:
            if len(word) > n and word[:n] in self.stems:
                return self.stems[word[:n]]
        return 0.0


def symbol_of(word: str, lexicon: Lexicon) -> tuple[str | None, float]:
    w = lexicon.weight(word)
    if w > 0:
        return "insult", w
    if word in THREATS:
        return "threat", THREAT_WEIGHT
    for name, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)):
        if word in words:
            return name, 0.0
    return None, 0.0


def clause_score(tokens: list[str], lexicon: Lexicon, grammar: Machine = GRAMMAR) -> float:
    """The weight of the best accepting path of the grammar over a clause: what its insults and threats add up to."""
    live = dict.fromkeys(grammar.starts, 0.0)
    for word in tokens:
        symbol, w = symbol_of(word, lexicon)
        if symbol:
            after: dict = {}
            for state, total in live.items():
                arc = grammar.step(state, symbol)
                if arc:
                    after[arc[0]] = max(after.get(arc[0], 0.0), total + w * arc[1])
            live = after
    return max((total for state, total in live.items() if state in grammar.finals), default=0.0)


def clause_features(text: str, lexicon: Lexicon) -> tuple[float, float, float]:
    """log(1 + sum), highest and log-share for the length of the scores of matched clauses."""
    low = text.lower()
    words = _WORD.findall(low)
    known = set(words)
    hits = {w for w in known if w in THREATS or lexicon.weight(w) > 0}
    insulting = any(lexicon.weight(w) > 0 for w in hits)
    if not hits or not insulting and known.isdisjoint(TARGETS):
        return 0.0, 0.0, 0.0
    scores, clause, met = [], [], False
    for token in [*_TOKEN.findall(low), "."]:
        if token in _ENDS:
            if met and (insulting or not TARGETS.isdisjoint(clause)):
                scores.append(clause_score(clause, lexicon))
            clause, met = [], False
        else:
            clause.append(token)
            met = met or token in hits
    total = sum(scores)
    return math.log1p(total), max(scores, default=0.0), math.log1p(100 * total / (20 + len(words)))


def document_score(text: str, lexicon: Lexicon) -> float:
    z = lexicon.model[0] + sum(w * x for w, x in zip(lexicon.model[1:], clause_features(text, lexicon)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms_of(text: str) -> set[str]:
    """The words of a text and, marked by a star, their beginnings."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n}


def build_lexicon(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, least: float = 1.2) -> Lexicon:
    """Log-odds of terms (term, toxic documents, other documents) that toxic documents favour."""
    words, stems = {}, {}
    for term, t, c in counts:
        odds = math.log((t + 0.3) / (n_toxic + 1)) - math.log((c + 0.3) / (n_clean + 1))
        if term.endswith("*"):
            if odds >= least and t >= 8 and t >= 0.45 * (t + c):
                stems[term[:-1]] = min(4.0, odds) * t / (t + c)
        elif t + c >= 4:
            words[term] = min(4.0, odds) if odds >= 2 and t >= 5 and t >= 0.6 * (t + c) else 0.0
    near = {w: x for w, x in words.items() if x > 0 or any(w[:n] in stems for n in STEMS)}
    return Lexicon({**dict.fromkeys(SEED_INSULTS, 1.5), **near}, stems)


def deciding(terms: DataFrame, n_toxic: int, n_clean: int, least: float = 1.2) -> DataFrame:
    """The rows of terms that build_lexicon keeps something of: accepted stems and words, and known words that begin with such a stem."""
    t, c, stem = F.col("t"), F.col("c"), F.col("term").endswith("*")
    odds = F.log((t + 0.3) / (n_toxic + 1)) - F.log((c + 0.3) / (n_clean + 1)) + 1e-9  # build_lexicon decides on the boundary
    stems = terms.where(stem & (t >= 8) & (t >= 0.45 * (t + c)) & (odds >= least))
    known = terms.where(~stem & (F.col("term") != "") & (t + c >= 4))
    begins = F.explode(F.array(*[F.concat(F.substring("term", 1, n), F.lit("*")) for n in STEMS])).alias("stem")
    near = known.select("*", begins).join(stems.select(F.col("term").alias("stem")), "stem", "left_semi").select("term", "t", "c")
    return stems.unionByName(known.where((t >= 5) & (t >= 0.6 * (t + c)) & (odds >= 2))).unionByName(near).distinct()


def fit_model(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's method with step halving; features that would count against toxicity are left out."""

    def loss(a: np.ndarray, w: np.ndarray) -> float:
        z = a @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge * np.sum(w[1:] ** 2) / 2)

    use = list(range(x.shape[1]))
    while True:
        a = np.c_[np.ones(len(x)), x[:, use]]
        w = np.zeros(a.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            penalty = np.r_[0.0, np.full(len(use), ridge)]
            step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(penalty + 1e-9), a.T @ (p - y) + penalty * w)
            size = 1.0
            while size > 1e-6 and loss(a, w - size * step) > loss(a, w):
                size /= 2
            w = w - size * step
        worst = int(np.argmin(w[1:])) if use else 0
        if not use or w[1 + worst] >= 0:
            full = np.zeros(x.shape[1] + 1)
            full[[0, *[1 + u for u in use]]] = w
            return tuple(full.tolist())
        del use[worst]


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> Lexicon:
    """Fit lexicon and model to at most max_labels labelled documents, the first by hash; labels: doc_id, toxic."""
    bounded_batches(docs.sparkSession)
    sample = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null")
    texts = scratch(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for b in batches:
            for text, label in zip(b["text"], b["toxic"]):
                (toxic if label else clean).update(terms_of(text))
                n[0 if label else 1] += 1
        terms = [*(toxic.keys() | clean.keys())]
        yield pd.DataFrame({"term": ["", *terms], "t": [n[0], *[toxic[x] for x in terms]], "c": [n[1], *[clean[x] for x in terms]]})

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [clause_features(t, lexicon) for t in b["text"]]
            yield pd.DataFrame(np.c_[np.asarray(x).reshape(len(b), 3), b["toxic"]], columns=["a", "b", "c", "y"])

    parts = scratch(texts.mapInPandas(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "terms")
    total = parts.where("term = ''").first()
    if total is None or not total.t or not total.c:
        return Lexicon()
    lexicon = build_lexicon([tuple(r) for r in deciding(parts, total.t, total.c).collect()], total.t, total.c)
    rows = np.asarray(sorted(tuple(r) for r in texts.mapInPandas(features, "a double, b double, c double, y double").collect()))
    lexicon.model = fit_model(rows[:, :3], rows[:, 3])
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """One row for each document: doc_id, score, predicted (1 if the score reaches the threshold)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [document_score(t or "", lexicon) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": s, "predicted": [int(x >= threshold) for x in s]})

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(score, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that the score doesn't reject; all columns stay."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: document_score(t or "", lexicon))

    bounded_batches(docs.sparkSession)
    return docs.where(score(F.col("text")) < threshold)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels whose crc32 of the doc_id as text leaves another remainder than 1 by 3; the others are held out."""
    return labels.where(~held_out())


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
