"""Secret scan: fixed formats, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of at least `window` characters of one character class (hex digits, or base64 and URL-safe base64
characters). Its entropy is kept over a sliding window by incremental counts; the candidate is a secret if the entropy of
some window reaches the threshold of its class, unless the allow-list knows it or a fixed format already covers it.

Defined results: null text counts as empty; an empty table gives an empty table; rows that repeat are scanned each; other
columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded_batches

#: Fixed formats: kind, pattern, least length of what counts (of group 2, if there is one).
FORMATS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 24),
)
#: Classes of candidate strings: kind, pattern of a run, least entropy of a window in bits. Base64 runs need two kinds of characters.
CLASSES = (("hex", re.compile(r"(?<![0-9A-Za-z+/_-])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{20,}(?![0-9A-Za-z+/_-])"), 2.9), ("base64", re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}"), 3.8))
#: Strings that look random and are no secrets: UUIDs, integrity hashes, placeholders, plain words.
ALLOWED = re.compile(r"(?i:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|sha(1|256|384|512)-.*|.*example.*|.*placeholder.*|[a-z/_-]+|[A-Z][a-z]+([A-Z][a-z]+)+|[0-9+/_-]+)", re.A)
WINDOW = 20


def highest_entropy(s: str, window: int = WINDOW) -> float:
    """The highest Shannon entropy, in bits, of the windows of s; of s itself if it is shorter."""
    w = min(window, len(s))
    if not w:
        return 0.0
    logs = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    count: dict[str, int] = {}
    total = 0.0
    best = math.inf
    for i, c in enumerate(s):
        if i >= w:
            old = s[i - w]
            n = count[old]
            total += logs[n - 1] - logs[n]
            count[old] = n - 1
        n = count.get(c, 0)
        total += logs[n + 1] - logs[n]
        count[c] = n + 1
        if i >= w - 1:
            best = min(best, total)
    return math.log2(w) - best / w


def _mixed(s: str) -> bool:
    return sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]")) >= 2 and bool(re.search("[0-9]", s))


def find_secrets(text: str, window: int = WINDOW) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind): all of the fixed formats, and kind `entropy` for further candidates."""
    spans = []
    for kind, pattern, least in FORMATS:
        for m in pattern.finditer(text):
            if len(m[2] if pattern.groups > 1 else m[0]) >= least:
                spans.append((m.start(), m.end(), kind))
    starts, reach = [], []  # sorted starts of the fixed formats' spans, and the furthest end up to each
    for a, b, _ in sorted(spans):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    more = []
    for kind, pattern, bits in CLASSES:
        for m in pattern.finditer(text):
            s = m[0]
            at = bisect.bisect_right(starts, m.start())
            if ALLOWED.fullmatch(s) or kind == "base64" and not _mixed(s) or at and reach[at - 1] >= m.end():
                continue
            if highest_entropy(s, window) >= bits:
                more.append((m.start(), m.end(), "entropy"))
    return spans + sorted(set(more))


def spell(spans: list[tuple[int, int, str]]) -> str:
    order = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))


def scan_secrets(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: counts by format, SHA-256 of the formats' spans, all spans, how many the entropy adds, and how many there are."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                spans = find_secrets(text or "", window)
                fixed = [x for x in spans if x[2] != "entropy"]
                n = [sum(x[2] == kind for x in fixed) for kind, *_ in FORMATS]
                out.append((doc_id, *n, hashlib.sha256(spell(fixed).encode()).hexdigest(), spell(spans), len(spans) - len(fixed), len(spans)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy", "n_spans"])

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(scan, schema)
