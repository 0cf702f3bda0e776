"""The corpus operators as registered queries, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.best_fit_packing import pack_documents
from corpusmill.llm.chat_format import conversation_digests
from corpusmill.llm.exact_dedup import duplicate_report
from corpusmill.llm.filter_audit import audit_filters
from corpusmill.llm.jaccard_join import jaccard_classes
from corpusmill.llm.pii import find_personal_data
from corpusmill.llm.quality_divergence import quality_verdicts
from corpusmill.llm.repeat_index import remove_repeats
from corpusmill.llm.secrets import scan_secrets
from corpusmill.llm.source_audit import audit_sources
from corpusmill.llm.source_mix import mix_sources
from corpusmill.llm.toxicity import held_out, score_toxicity, train, training_labels
from corpusmill.llm.url_reputation import judge_urls

#: The rules of op9 and the conversation that op6 adds: fixed values.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
EXTRA_TURNS = "values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lexicon = train(docs, training_labels(labels))
    scored = score_toxicity(docs, lexicon)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(f"select * from {EXTRA_TURNS}"))
    return conversation_digests(turns).drop("layout", "fingerprint")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_report(_table(spark, sf_dir, "documents"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of its number: bad if of low quality or toxic."""
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    return judge_urls(_table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(_table(spark, sf_dir, "documents"))


def op13_repeat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_source_mix, op3_quality_divergence, op4_pii, op5_secrets, op6_chat_format, op7_jaccard_join, op8_exact_dedup, op9_url_reputation, op10_best_fit_packing,
        op11_filter_audit, op12_source_audit, op13_repeat_index,
    )
}

_MIX = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS deal
  FROM documents),
t0 AS (SELECT key, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY key, source),
t1 AS (SELECT *, [5, 2, 1][(nth - 1) % 3 + 1] AS weight FROM t0),
t2 AS (SELECT *, 2e0 * source_size / weight AS ratio, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights FROM t1),
t3 AS (SELECT *, coalesce(sum(source_size) OVER w, 0)::BIGINT AS done, coalesce(sum(weight) OVER w, 0)::BIGINT AS used FROM t2
       WINDOW w AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t4 AS (SELECT *, (15e-1 * total - 2e0 * done) / (weights - used) AS own FROM t3),
t5 AS (SELECT *, max(CASE WHEN ratio >= own THEN own END) OVER () AS level FROM t4),
t6 AS (SELECT *, CASE WHEN ratio < level THEN 2e0 * source_size ELSE level * weight END AS target FROM t5),
t7 AS (SELECT *, round(target)::BIGINT AS words, greatest(1, ceil(sum(target) OVER () / 131072))::BIGINT AS bw FROM t6),
t8 AS (SELECT key, source_size, target, bw, ceil(source_size / bw::DOUBLE)::BIGINT AS blocks, words % greatest(source_size, 1) AS rest, words // greatest(source_size, 1) AS rounds FROM t7),
t AS (SELECT *, rounds * blocks + ceil(rest / bw::DOUBLE)::BIGINT AS quota FROM t8),
ranks AS (SELECT key, bw, source_size, blocks, rest, quota, unnest(range(quota)) AS nth FROM t WHERE quota > 0),
slots AS (SELECT key, nth % blocks AS block, least(bw, source_size - (nth % blocks) * bw) AS whole,
                 CASE WHEN nth = quota - 1 AND rest > 0 THEN rest - (rest - 1) // bw * bw END AS cut FROM ranks),
takes AS (SELECT key, block, count(*) FILTER (coalesce(cut, whole) = whole) AS times, max(cut) FILTER (cut < whole) AS cut FROM slots GROUP BY key, block),
placed AS (SELECT d.doc_id, d.key, d.size, t.source_size, t.target, t.bw,
                  (sum(d.size) OVER (PARTITION BY d.key ORDER BY deal, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start FROM d JOIN t USING (key)),
parts AS (SELECT *, unnest(range(start // bw, (start + size - 1) // bw + 1)) AS block FROM placed WHERE size > 0),
cuts AS (SELECT p.*, greatest(start, p.block * bw) AS a, least(start + size, (p.block + 1) * bw) AS z, coalesce(times, 0) AS times, cut FROM parts p LEFT JOIN takes k ON k.key = p.key AND k.block = p.block)
SELECT doc_id, size, source_size, target, sum(times * (z - a) + CASE WHEN cut IS NULL THEN 0 ELSE greatest(0, least(z, block * bw + cut) - a) END)::BIGINT AS taken
FROM cuts GROUP BY doc_id, key, start, size, source_size, target
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM placed WHERE size = 0
"""

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
e AS (SELECT *, length(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'),
                '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>'), '<|endoftext|>', '<\|endoftext|>')) AS escaped FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(role) + 1 + escaped + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""

_DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""

_URLS = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(greatest(1 - quality, toxic)) AS bad FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
hn AS (SELECT host, n, bad, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS name FROM h),
hp AS (SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '^([0-9]+(\.[0-9]+){3}|\[.*\])$') AS ip, regexp_matches(name, '(^|\.)(ac|co|com|edu|gen|go|gob|gov|gouv|govt|gv|id|info|me|mil|ne|net|nom|or|org|school|sch|web)\.[a-z]{2}$') AS two FROM hn),
hd AS (SELECT host, CASE WHEN ip THEN name ELSE array_to_string(parts[CASE WHEN two THEN -3 ELSE -2 END:], '.') END AS domain, CASE WHEN ip THEN name ELSE array_to_string(parts[CASE WHEN two THEN -2 ELSE -1 END:], '.') END AS suffix, n, bad FROM hp),
al AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS overall FROM hd),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hd GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
sm AS (SELECT suffix, (10 * ((sum(bad) OVER () + 1) / (sum(n) OVER () + 2)) + bad) / (10 + n) AS prior FROM s),
m AS (SELECT 'd' AS level, suffix AS parent, n, bad FROM d UNION ALL SELECT 'h', domain, n, bad FROM hd),
a AS (SELECT level, parent, count(*) FILTER (n > 0) - 1 AS k1, sum(n) AS sn, sum(n * n) AS sn2, sum(bad) AS sb, sum(CASE WHEN n > 0 THEN bad * bad / n ELSE 0 END) AS sb2 FROM m GROUP BY ALL),
b AS (SELECT *, CASE WHEN k1 > 0 AND sb > 0 AND sb < sn AND sn - sn2 / sn > k1
             THEN least(greatest(((sb2 - 2 * (sb / sn) * sb + (sb / sn) * (sb / sn) * sn) / ((sb / sn) * (1 - sb / sn)) - k1) / (sn - sn2 / sn - k1), 1e-3), 99e-2) END AS rho FROM a),
g AS (SELECT level, parent, coalesce(1 / rho - 1, 10) AS strength FROM b),
dm AS (SELECT d.domain, (g.strength * sm.prior + d.bad) / (g.strength + d.n) AS prior FROM d JOIN sm USING (suffix) JOIN g ON g.level = 'd' AND g.parent = d.suffix),
r AS (SELECT hd.host, g.strength * dm.prior + hd.bad AS a, g.strength * (1 - dm.prior) + hd.n - hd.bad AS b FROM hd JOIN dm USING (domain) JOIN g ON g.level = 'h' AND g.parent = hd.domain),
v AS (SELECT host, a / (a + b) - 1645e-3 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM r),
u AS (SELECT page_id, host, path,
             CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
                  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
                  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
                  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound >= 125e-2 * overall THEN 'block' ELSE 'allow' END AS verdict
FROM u JOIN v USING (host), al
"""

_FILTERS = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
p AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(f, v)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS v FROM x a, x b, x c, x d, x e WHERE a.v + b.v + c.v + d.v + e.v = 31),
s AS (SELECT filter_order, step, v[step] AS own, CASE step WHEN 1 THEN 0 WHEN 2 THEN v[1] WHEN 3 THEN v[1] + v[2] WHEN 4 THEN v[1] + v[2] + v[3] ELSE v[1] + v[2] + v[3] + v[4] END AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) n),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (fails & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & own != 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (fails & before != 0 AND fails & own != 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
             coalesce(sum(n) FILTER (fails & before = 0 AND fails & own != 0 AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails & before = 0 AND fails & own != 0 AND toxic = 1), 0)::BIGINT AS toxic_lost
      FROM p, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""

_SOURCES = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(v.v, 0) AS v, coalesce(v.n, 0) AS lang_n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN v ON v.lang = d.lang),
n AS (SELECT g.lang, g.source, g.v, g.lang_n, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
e AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (n.n + n.v))::HUGEINT AS p, (1 + 1000000000::HUGEINT * (k.total + 1) // (n.lang_n + n.v))::HUGEINT AS lang_p
      FROM n JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
q AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
m AS (SELECT lang, source, 'term' AS part, term AS item, ((p - lang_p) * (p - lang_p) // lang_p)::BIGINT AS value FROM e WHERE c > 0 AND p > lang_p),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM q UNION ALL SELECT * FROM m))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM u WHERE part = 'pair' OR rank <= 200
"""

_REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d WHERE len(x) >= 400),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM s),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
b AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM m),
k AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM b),
p AS (SELECT r, run, min(i) AS a, max(i) + 200 AS z FROM k GROUP BY r, run),
o AS (SELECT p.r, a, z, substr(x, 2 * lag(z, 1, 0) OVER (PARTITION BY p.r ORDER BY a) + 1, 2 * (a - lag(z, 1, 0) OVER (PARTITION BY p.r ORDER BY a))) AS kept FROM p JOIN d ON d.r = p.r),
j AS (SELECT r, sum(z - a) AS gone, count(*) AS runs, max(z) AS z, string_agg(kept, '' ORDER BY a) AS kept FROM o GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN j ON j.r = d.r
"""

ORACLE_SQL = {"op2_source_mix": _MIX, "op6_chat_format": _CHAT, "op7_jaccard_join": _JACCARD, "op8_exact_dedup": _DEDUP, "op9_url_reputation": _URLS, "op11_filter_audit": _FILTERS, "op12_source_audit": _SOURCES, "op13_repeat_index": _REPEATS}
