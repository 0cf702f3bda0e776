r"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans: the four fixed formats (email, ip, card, phone), loose runs of digits,
and spelled-out addresses. Each span gets features of its format (digits, separators, groups) and of its context (words
before it, characters around it). Boosted trees score what the fixed formats don't take; the threshold is calibrated on
held-out candidates so that the wanted share of what it selects is right. All labelled candidates count: by hash three of
four are learned from and the fourth is held out. Those with equal features, label and kind make one row, weighted by
their number, so what the trees read grows with the variety of candidates and not with the corpus.

Labels are those of spans that could be added, never of whether a fixed format covers them. Right are valid
phones and emails in a spelling that no fixed format takes (without +, as a national number, with "(at)" for @), one for each
valid span. Wrong are uncovered numbers that fail a fixed format, are a date or a decimal, stand inside a word, follow a word such as "id" or "page" or
have too few digits for a phone, and addresses that don't end in letters. All else has no label: it is scored, but neither
learned from nor tested on. The fixed formats' own checks (Luhn, parts up to 255) are no features. Each kind has its own
threshold, the lowest from 0.5 on that reaches the precision; where none reaches the precision on 20 held-out candidates at least, nothing of the kind is added.

Patterns are written for Java with possessive quantifiers and a start at the end of the last match or of a run, which gives
the same leftmost matches as the plain patterns in linear time and without recursion.

Defined results: null text counts as empty; rows that repeat are scanned each; an empty table gives an empty table; other
columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from math import isqrt

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.shared import scratch

#: Kinds in order: name, pattern, what a text must hold to be searched.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
LOOSE = (
    ("number", r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++", None),
    ("address", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z0-9-]++)++", "at"),
)
KINDS = [k for k, *_ in BASE] + [k for k, *_ in LOOSE]
FEATURES = ("n_digits", "n_chars", "n_separators", "n_groups", "n_spaces", "n_dots", "n_dashes", "plus", "parenthesis", "leading_zero", "letter_before", "letter_after", "word_number", "word_phone", "word_card", "word_mail", "word_secret", "letters_last")
#: Words of the context, left of a span. Fixed values.
CONTEXT = {
    "word_number": r"(?i)(?<![A-Za-z])(?:no|nr|num|number|id|order|page|version|isbn|doi)[^A-Za-z0-9]*$",
    "word_phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|telefon|téléphone|teléfono)(?:[^A-Za-z0-9]*(?:no|nr|num|number))?[^A-Za-z0-9]*$",
    "word_card": r"(?i)(?:card|visa|master|iban|account|konto|carte|tarjeta)[^A-Za-z0-9]*$",
    "word_mail": r"(?i)(?:mail|email|contact|kontakt|correo)[^A-Za-z0-9]*$",
    "word_secret": r"(?i)(?:token|key|secret|hash|commit|sha)[^A-Za-z0-9]*$",
}

#: Dates, ranges of years and decimals: runs of digits that are spelled like phones and aren't.
DATED = r"^(?:(?:19|20)[0-9]{2}[.-](?:0?[1-9]|1[0-2])[.-](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[.-](?:0?[1-9]|[12][0-9]|3[01])[.-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}\x20?-\x20?(?:19|20)[0-9]{2}|[0-9]+\.[0-9]+)$"


def _pieces(text: Column, kind: str, pattern: str, needs: str | None) -> Column:
    """array<struct<kind,i,gap,left,right,span>>: matches with the length and the ends of the text between them."""
    # one element binds both arrays to a lambda variable, so that each is computed once for a text
    bound = F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found")))

    def rows_of(s: Column) -> Column:
        gaps = s["gaps"]
        return F.transform(s["found"], lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).cast("long").alias("gap"), F.right(F.get(gaps, i), F.lit(24)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("right"), m.alias("span")))

    rows = F.get(F.transform(bound, rows_of), F.lit(0))
    has = F.lit(True) if needs is None else text.contains(needs)
    return F.when(has, rows).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:bigint,left:string,right:string,span:string>>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(numbers, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def propose(docs: DataFrame) -> DataFrame:
    """One row for each candidate of each document (row, key, doc_id, kind, start, end, span, left, right, valid).

    A document without candidates gives one row with a null kind, so that every document stays. The window orders the
    candidates of one document and kind; nothing larger comes together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digits = text.rlike("[0-9]")
    none = F.array().cast("array<struct<kind:string,i:int,gap:bigint,left:string,right:string,span:string>>")
    numeric = F.when(digits, F.concat(*[_pieces(text, *k) for k in (BASE[1], BASE[2], BASE[3], LOOSE[0])])).otherwise(none)
    every = F.concat(_pieces(text, *BASE[0]), numeric, _pieces(text, *LOOSE[1]))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", "text").alias("key"), every.alias("c")).select("row", "key", "doc_id", F.explode_outer("c").alias("c")).select("row", "key", "doc_id", "c.*")
    rows = rows.repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("span").cast("long")
    placed = rows.withColumn("end", F.sum(F.col("gap") + length).over(upto)).withColumn("start", F.col("end") - length)
    bare = F.regexp_replace("span", "[^0-9]", "")
    parts = F.split("span", r"\.")
    valid = (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.forall(parts, lambda p: p.rlike("^0*(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")))
        .when(F.col("kind") == "card", F.length(bare).between(14, 19) & luhn(F.substring(bare, 1, 20)))
        .when(F.col("kind") == "phone", F.length(bare).between(10, 15))
    )
    return placed.select("row", "key", "doc_id", "kind", "start", "end", "span", "left", "right", valid.alias("valid"))


def with_features(candidates: DataFrame) -> DataFrame:
    span, left = F.col("span"), F.coalesce(F.col("left"), F.lit(""))
    count = lambda chars: F.length(span) - F.length(F.regexp_replace(span, chars, ""))
    values = {
        "n_digits": count("[0-9]"), "n_chars": F.length(span), "n_separators": count(r"[\x20().-]"), "n_groups": F.size(F.split(span, "[^0-9]+")), "n_spaces": count(r"\x20"), "n_dots": count(r"\."), "n_dashes": count("-"),
        "plus": span.startswith("+"), "parenthesis": span.contains("("), "leading_zero": span.rlike("^[+(]?0"), "letter_before": left.rlike(r"[A-Za-z0-9_]$"), "letter_after": F.coalesce(F.col("right"), F.lit("")).rlike("^[A-Za-z0-9_@]"), "letters_last": span.rlike("[A-Za-z]{2}$"),
    } | {k: left.rlike(p) for k, p in CONTEXT.items()}
    values["word_number"] = values["word_number"] & ~values["word_phone"]  # "phone no." is no other number
    return candidates.select("*", *[values[k].cast("double").alias(k) for k in FEATURES])


def _base_cover(candidates: DataFrame) -> DataFrame:
    """Add `covered`: a valid span of a fixed format overlaps the candidate. The running end of the valid spans decides, from both sides."""
    ends = F.when(F.col("valid"), F.col("end"))
    starts = F.when(F.col("valid"), F.col("start"))
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    hit = (F.max(ends).over(before) > F.col("start")) | (F.min(starts).over(after) < F.col("end"))
    return candidates.withColumn("covered", F.coalesce(hit, F.lit(False)))


def respelled(candidates: DataFrame) -> DataFrame:
    """Valid phones and emails as (key, start, kind, span, left, right) of a loose kind, each in one of the spellings, by hash."""
    span, left = F.col("span"), F.coalesce(F.col("left"), F.lit(""))
    groups = F.regexp_extract_all("span", F.lit("[0-9]+"), 0)
    national = F.when(F.size(groups) > 2, F.slice(groups, 2, F.greatest(F.size(groups), F.lit(1)))).otherwise(groups)
    local, host = F.substring_index("span", "@", 1), F.substring_index("span", "@", -1)
    dots = lambda dot: F.regexp_replace(host, r"\.", dot)
    phones = [F.substring(span, 2, 1000), F.regexp_replace(span, r"^\+[0-9]+[\x20.-]*", ""), *[F.array_join(national, x) for x in "-. "], F.concat(F.lit("0"), F.array_join(national, " ")), F.concat(F.lit("00"), F.array_join(groups, " "))]
    spellings = {
        ("phone", "number"): [F.struct(x.alias("span"), left.alias("left")) for x in phones] + [F.struct(F.array_join(national, "").alias("span"), F.lit("phone ").alias("left"))],
        ("email", "address"): [F.struct(F.concat(local, F.lit(at), x).alias("span"), left.alias("left")) for at, x in ((" (at) ", dots(" (dot) ")), (" [at] ", dots(" [dot] ")), ("(at)", dots("(dot)")), (" (at) ", host), ("[at]", host))],
    }
    every = None
    for (kind, loose), forms in spellings.items():
        one = F.get(F.array(*forms), F.pmod(F.xxhash64("start", "key", F.lit("spelling")), F.lit(len(forms))).cast("int"))
        rows = candidates.where((F.col("kind") == kind) & F.col("valid")).select("key", "start", F.lit(loose).alias("kind"), one.alias("s"), "right").select("key", "start", "kind", "s.span", "s.left", "right")
        every = rows if every is None else every.unionByName(rows)
    digits = F.length(F.regexp_replace("span", "[^0-9]", ""))
    pattern = {k: p for k, p, _ in LOOSE}
    phone = (F.col("kind") == "number") & digits.between(7, 17) & F.col("span").rlike(f"^{pattern['number']}$")
    return every.where(phone | (F.col("kind") == "address") & F.col("span").rlike("[A-Za-z]{2}$"))


def labelled(candidates: DataFrame) -> DataFrame:
    """Features and label of every candidate that could be added and whose label is known."""
    keys = ["key", "start", "kind", "span"]
    right = with_features(respelled(candidates)).select(*keys, *FEATURES, F.lit(1.0).alias("label"))
    loose = with_features(candidates.where(F.col("kind").isin(*[k for k, *_ in LOOSE]) & ~F.col("covered")))
    is_ = lambda name: F.col(name) == 1.0
    span, digits = F.col("span"), F.col("n_digits")
    fails = span.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") | span.rlike(r"^(?!00)[0-9](?:[\x20-]?[0-9])++$") & (digits >= 14) | is_("plus") | span.rlike(DATED)
    apart = ~is_("word_phone") & (is_("word_number") | is_("word_secret") | is_("letter_before") | is_("letter_after"))
    wrong = F.when(F.col("kind") == "number", fails | apart | (digits < 7)).otherwise(~is_("letters_last"))
    return right.unionByName(loose.where(wrong).select(*keys, *FEATURES, F.lit(0.0).alias("label")))


def weighted(labels: DataFrame) -> DataFrame:
    """Labelled candidates by kind, features, label and held_out, with their number n: no candidate is left out."""
    alike = ["kind", *FEATURES, "label", "held_out"]
    return labels.withColumn("held_out", F.pmod(F.xxhash64("key", "start"), F.lit(4)) == 0).groupBy(*alike).agg(F.count("*").alias("n")).sortWithinPartitions(*alike)


def _bins(rows: int) -> int:
    """maxBins with which MLlib takes its split points from all rows: beyond 10,000 rows it draws maxBins squared of them."""
    return 32 if rows <= 10_000 else isqrt(rows) + 1


def fit(candidates: DataFrame, max_candidates: int | None = None, trees: int = 20, depth: int = 4, precision: float = 0.95):
    """(model, thresholds by kind) from all labelled candidates, or None if there are too few or none passes. A caller may bound them by max_candidates, the first by hash."""
    labels = labelled(candidates)
    if max_candidates is not None:
        labels = labels.orderBy(F.xxhash64("key", "start", "span"), "key", "start", "kind", "span").limit(max_candidates)
    known = scratch(weighted(labels), "candidates")
    learned = known.where("not held_out")
    totals = {r.label: r for r in learned.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    if len(totals) < 2 or min(r.n for r in totals.values()) < 20:
        return None
    rows = sum(r.rows for r in totals.values())
    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="features"), GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxBins=_bins(rows), weightCol="n")]
    model = Pipeline(stages=stages).fit(learned.coalesce(max(4, rows // 50_000)))
    checked = _probability(model, known.where("held_out"))
    steps = checked.where("p >= 0.5").groupBy("kind", F.floor(F.col("p") * 50).alias("step")).agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect()
    best = {}
    for kind, *_ in LOOSE:
        found = {s.step: s for s in steps if s.kind == kind}
        right, n = 0.0, 0
        for step in range(50, 24, -1):  # steps without candidates too: the threshold doesn't hang on where the lowest right one lies
            if step in found:
                right, n = right + found[step].right, n + found[step].n
            if n >= 20 and right >= precision * n:
                best[kind] = step / 50
    return (model, best) if best else None


def _probability(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans."""
    candidates = scratch(_base_cover(propose(docs)), "spans")
    loose = with_features(candidates.where(F.col("kind").isin(*[k for k, *_ in LOOSE])))
    fitted = fit(candidates, **options)
    base = candidates.where("kind is null or valid is not null").select("row", "doc_id", F.when(F.col("valid"), F.col("kind")).alias("kind"), "start", "end")
    if fitted:
        model, thresholds = fitted
        reached = F.lit(False)
        for kind, threshold in thresholds.items():
            reached = reached | (F.col("kind") == kind) & (F.col("p") >= threshold)
        added = _probability(model, loose.where("not covered")).where(reached).select("row", "doc_id", "kind", "start", "end")
        base = base.unionByName(added)
    rest = candidates.where(~(F.col("kind").isNull() | F.col("valid").isNotNull())).select("row", "doc_id", F.lit(None).cast("string").alias("kind"), "start", "end")
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    found = base.unionByName(rest).groupBy("row", "doc_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", order.alias("order"), "end", "kind")))).alias("spans"),
    )
    spell = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    fixed = F.filter("spans", lambda s: s["order"] < len(BASE))
    counts = [f"n_{k}" for k, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(spell(fixed), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"), (F.col("n_number") + F.col("n_address")).alias("n_added"), F.size("spans").cast("long").alias("n_spans"))
