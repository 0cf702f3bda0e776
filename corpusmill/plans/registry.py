"""Every operator bound to the driver's tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as P
from corpusmill.operators import analysis as A
from corpusmill.operators import approximate as N
from corpusmill.operators import chunking as C
from corpusmill.operators import diff as D
from corpusmill.operators import embedding as V
from corpusmill.operators import evaluation as E
from corpusmill.operators import graph as G
from corpusmill.operators import grounding as K
from corpusmill.operators import jobs as J
from corpusmill.operators import retrieval as R
from corpusmill.plans import fixtures as X
from corpusmill.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
now = lambda: F.expr(X.NOW)
DNOW = "TIMESTAMP '2024-01-02 00:00:00'"


def query(name: str, sql: str | None = None):
    """Register a query under `name` with its DuckDB twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def alternatives(words: tuple[str, ...]) -> str:
    return "(" + "|".join(w.replace(".", r"\.") for w in words) + ")"


def intent_sql(column: str, intents: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{alternatives(w)}') THEN '{n}'" for n, w in intents.items()) + " ELSE 'general' END"


# --- sources and sinks -------------------------------------------------------------------------------------------------

_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query("s2_filter_source_files", f"""WITH {X.FILES}, p AS (SELECT repo_id, file_path, string_split(file_path, '/') AS d FROM files),
q AS (SELECT *, regexp_extract(lower(d[-1]), '^.+\\.([^.]+)$', 1) AS s FROM p) SELECT repo_id, file_path FROM q
WHERE (s IN ({_LIST(S.SUFFIXES)}) OR lower(d[-1]) IN ({_LIST(S.FILE_NAMES)})) AND NOT list_has_any(d[:len(d) - 1], [{_LIST(S.SKIPPED_DIRS)}])""")
def s2(spark, d):
    return S.filter_source_files(X.files(spark, d)).select("repo_id", "file_path")


@query("s3_capacity_guard", f"WITH {X.FILES} SELECT repo_id, count(*) AS n, CASE WHEN count(*) > 49 THEN 'FILE_LIMIT_EXCEEDED' END AS error_code FROM files GROUP BY repo_id")
def s3(spark, d):
    return S.capacity_guard(X.files(spark, d), 49, "FILE_LIMIT_EXCEEDED")


@query("s5_upsert_analysis", f"WITH {X.RESULTS}, u AS (SELECT * FROM results UNION ALL SELECT repo_id, job_id, quality_score + 1, created_at + INTERVAL 1 DAY, languages FROM results WHERE quality_score % 2 = 0) SELECT job_id, repo_id, quality_score, created_at FROM u QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, quality_score DESC) = 1")
def s5(spark, d):
    old = X.results(spark, d).select("job_id", "repo_id", "quality_score", "created_at")
    new = old.where("quality_score % 2 = 0").select("job_id", "repo_id", (F.col("quality_score") + 1).alias("quality_score"), F.expr("created_at + interval 1 day").alias("created_at"))
    return S.upsert_analysis(old, new)


_FIELDS = {"github_url": "'https://x/' || k", "owner": "'w' || k % 5", "name": "'n' || k", "default_branch": "'main'", "latest_commit_sha": "'h' || k", "description": "CASE WHEN k % 3 = 0 THEN NULL ELSE 'd' || k END", "stars": "CAST(k % 1000 AS INT)", "forks": "CAST(k % 10 AS INT)", "language": "'py'", "size_kb": "CAST(k % 77 AS INT)"}
_ALL_FIELDS = ", ".join(f"{sql} AS {c}" for c, sql in _FIELDS.items())


@query("s6_upsert_repositories", f"""WITH e AS (SELECT 'r' || c_custkey AS full_name, 'i' || c_custkey AS id, {_ALL_FIELDS} FROM (SELECT *, c_custkey + 5 AS k FROM customer) WHERE c_custkey % 2 = 0),
n AS (SELECT 'r' || o_custkey AS full_name, 'n' || o_orderkey AS id, {_ALL_FIELDS} FROM (SELECT *, o_orderkey AS k FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'n' || o_orderkey DESC) = 1)
SELECT full_name, coalesce(e.id, n.id) AS id, {', '.join(f'CASE WHEN n.id IS NULL THEN e.{c} ELSE n.{c} END AS {c}' for c in _FIELDS)} FROM e FULL JOIN n USING (full_name)""")
def s6(spark, d):
    fields = [f"{sql} AS {c}" for c, sql in _FIELDS.items()]
    old = X.table(spark, d, "customer").where("c_custkey % 2 = 0").withColumn("k", F.expr("c_custkey + 5")).selectExpr("concat('r', c_custkey) full_name", "concat('i', c_custkey) id", *fields)
    new = X.table(spark, d, "orders").withColumn("k", F.col("o_orderkey")).selectExpr("concat('r', o_custkey) full_name", "concat('n', o_orderkey) id", *fields, "o_orderdate snapshot_at")
    return S.upsert_repositories(old, new)


@query("s7_latest_commit_diff", f"WITH {X.DIFFS} SELECT repo_id, head_sha FROM dl QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY doc_id DESC) = 1")
def s7(spark, d):
    return S.latest_commit_diff(X.diffs(spark, d)).select("repo_id", "head_sha")


@query("s10_export_shared_analysis", f"""WITH {X.RESULTS}, {X.REPOS}, {X.TOKENS}, l AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, job_id DESC) = 1)
SELECT share_id, t.repo_id, full_name, quality_score, coalesce(languages, '{{}}') AS languages_json FROM tokens t JOIN repositories USING (repo_id) LEFT JOIN l ON l.repo_id = t.repo_id WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '1996-01-01'""")
def s10(spark, d):
    return S.export_shared_analysis(X.tokens_table(spark, d), X.repositories(spark, d), X.results(spark, d), F.expr("timestamp'1996-01-01'"))


# --- projections and predicates ----------------------------------------------------------------------------------------


@query("p1_language_tag", f"WITH {X.FILES} SELECT file_path, repo_id, CASE WHEN file_path = 'README.md' THEN 'md' ELSE regexp_extract(file_path, '[^.]+$') END AS tag FROM files")
def p1(spark, d):
    return X.files(spark, d).select("file_path", "repo_id", P.language_tag(F.col("file_path")).alias("tag"))


@query("p2_split_lines", f"WITH {X.LINES} SELECT doc_id, len(lines) AS n, sha256(array_to_string(lines, '|')) AS h FROM lined")
def p2(spark, d):
    lines = P.split_lines(F.col("content"))
    return X.files(spark, d).select("doc_id", F.size(lines).cast("long").alias("n"), F.sha2(F.array_join(lines, "|"), 256).alias("h"))


@query("p3_normalize_language", f"WITH {X.FILES}, t AS (SELECT file_path, repo_id, regexp_extract(file_path, '[^.]+$') AS x FROM files) SELECT file_path, repo_id, CASE x WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'go' THEN 'Go' WHEN 'md' THEN 'Markdown' WHEN 'js' THEN 'JavaScript' ELSE x END AS language FROM t")
def p3(spark, d):
    return X.files(spark, d).select("file_path", "repo_id", P.normalize_language(F.concat(F.lit(" "), F.upper(F.regexp_extract("file_path", "[^.]+$", 0)), F.lit(" "))).alias("language"))


_ASKED = "(SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL)"


@query("p4_chat_intent", f"SELECT conv_id, turn, {intent_sql('text', P.CHAT_INTENTS)} AS intent FROM {_ASKED}")
def p4(spark, d):
    return X.table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", P.first_intent(F.col("text"), P.CHAT_INTENTS).alias("intent"))


@query("p5_question_kind", f"SELECT conv_id, turn, regexp_matches(lower(text), '{alternatives(P.LANGUAGE_QUESTIONS)}') AS language, regexp_matches(lower(text), '{alternatives(P.SUMMARY_QUESTIONS)}') AS summary FROM {_ASKED}")
def p5(spark, d):
    return X.table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", P.holds_any(F.col("text"), P.LANGUAGE_QUESTIONS).alias("language"), P.holds_any(F.col("text"), P.SUMMARY_QUESTIONS).alias("summary"))


@query("p6_diff_intent", f"SELECT conv_id, turn, {intent_sql('text', P.DIFF_INTENTS)} AS intent FROM {_ASKED}")
def p6(spark, d):
    return X.table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", P.first_intent(F.col("text"), P.DIFF_INTENTS).alias("intent"))


@query("p7_tokenize", "SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS tokens FROM benchmark")
def p7(spark, d):
    return X.table(spark, d, "benchmark").select("item_id", F.array_sort(P.tokens(F.col("text"))).alias("tokens"))


@query("p8_canonical_repo_key", r"""WITH m AS (SELECT regexp_extract(url, '(?i)^(https?)://([a-z0-9.-]+)/([^/?#]+)/([^/?#]+)(?:[/?#].*)?$', ['s', 'h', 'o', 'n']) AS m FROM pages)
SELECT DISTINCT 'https://' || lower(m.h) || '/' || m.o || '/' || regexp_replace(m.n, '\.git$', '') AS canonical, m.o || '/' || regexp_replace(m.n, '\.git$', '') AS full_name FROM m WHERE m.n <> ''""")
def p8(spark, d):
    return P.canonical_urls(X.table(spark, d, "pages"), host="[a-z0-9.-]+")


@query("p9_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def p9(spark, d):
    return X.table(spark, d, "documents").select("doc_id", P.content_hash(F.col("text")).alias("content_hash"))


_WEIGHT = f"CASE WHEN lower(p) LIKE '%readme.md' THEN 0 WHEN regexp_matches(lower(p), '{alternatives(P.MANIFESTS)}$') THEN 1 WHEN regexp_matches(lower(p), '{alternatives(P.DOCKER_FILES)}$') THEN 2 WHEN regexp_matches(lower(p), '{alternatives(P.ENTRY_POINTS)}') THEN 3 WHEN regexp_matches(lower(p), '{alternatives(P.SOURCE_DIRS)}') THEN 4 ELSE 5 END"


@query("p10_path_weight", f"WITH {X.FILES}, f AS (SELECT doc_id, 'x/' || file_path AS p FROM files) SELECT doc_id, {_WEIGHT} AS weight FROM f")
def p10(spark, d):
    return X.files(spark, d).select("doc_id", P.path_weight(F.concat(F.lit("x/"), F.col("file_path"))).alias("weight"))


@query("p11_is_test_path", f"WITH {X.FILES} SELECT doc_id, (lower(file_path) LIKE '%/tests/%' OR lower(file_path) LIKE 'tests/%' OR contains(lower(file_path), 'test_')) AS is_test FROM files")
def p11(spark, d):
    return X.files(spark, d).select("doc_id", P.is_test_path(F.col("file_path")).alias("is_test"))


_PAYLOAD = "concat('{\"event\":\"', event_type, '\",\"route\":\"/r', user_id % 9, '\",\"duration_ms\":', if(event_id % 3 = 0, '\"x\"', cast(event_id % 500 as string)), if(event_id % 4 = 0, ',\"metadata\":{\"k\":1}', ''), if(event_id % 11 = 0, '', '}'))"


def client_payloads(spark, d):
    return X.table(spark, d, "events").select("event_id", "ts", F.expr(_PAYLOAD).alias("payload"))


@query("p12_normalize_client_event", "SELECT event_id, event_type AS event, '/r' || user_id % 9 AS route, CASE WHEN event_id % 3 <> 0 THEN (event_id % 500)::DOUBLE END AS duration_ms, CASE WHEN event_id % 4 = 0 THEN '{\"k\":1}' ELSE '{}' END AS metadata FROM events WHERE event_id % 11 <> 0")
def p12(spark, d):
    return P.client_events(client_payloads(spark, d)).select("event_id", "event", "route", "duration_ms", "metadata")


# --- chunking ----------------------------------------------------------------------------------------------------------


@query("c1_line_window_chunks", f"WITH {X.CHUNKS} SELECT chunk_id, repo_id, file_path, start_line, end_line, sha256(content) AS h FROM chunks")
def c1(spark, d):
    return X.chunks(spark, d).select("chunk_id", "repo_id", "file_path", "start_line", "end_line", F.sha2("content", 256).alias("h"))


@query("c2_window_spans", f"""WITH {X.LINES}, s AS (SELECT doc_id, len(lines) AS n FROM lined WHERE len(lines) > 0), w AS (SELECT *, unnest(range(CASE WHEN n <= 5 THEN 1 ELSE 1 + ceil((n - 5) / 3.0)::INT END)) AS i FROM s)
SELECT doc_id, (10 + i * 3)::INT AS start_line, least(10 + i * 3 + 4, 9 + n)::INT AS end_line FROM w""")
def c2(spark, d):
    spans = X.files(spark, d).select("doc_id", F.lit(10).alias("first"), (9 + F.size(P.split_lines(F.col("content")))).alias("last"))
    return C.window_spans(spans, 5, 2).select("doc_id", "start_line", "end_line")


def source_texts(spark, d):
    """Texts as code: every fourth line opens a definition, the lines after it are its body."""
    lines = P.split_lines(F.col("content"))
    code = F.array_join(F.transform(lines, lambda x, i: F.when(i % 4 == 1, F.concat(F.lit("def f("), x)).when(i % 4 == 0, F.concat(F.lit("x"), x)).otherwise(F.concat(F.lit("  "), x))), "\n")
    path = F.expr("if(file_path = 'README.md', concat('README', doc_id, '.md'), file_path)")
    return X.files(spark, d).select("repo_id", path.alias("file_path"), F.when(F.expr("doc_id % 2 = 0"), code).otherwise(F.col("content")).alias("content"), "doc_id")


_CODED = X.LINES + """, coded AS (SELECT repo_id, CASE WHEN file_path = 'README.md' THEN 'README' || doc_id || '.md' ELSE file_path END AS file_path, doc_id, regexp_extract(file_path, '[^.]+$') AS language, unnest(list_transform(lines, lambda x, i: CASE WHEN doc_id % 2 = 1 THEN x WHEN (i - 1) % 4 = 1 THEN 'def f(' || x WHEN (i - 1) % 4 = 0 THEN 'x' || x ELSE '  ' || x END)) AS line,
 unnest(range(1, len(lines) + 1)) AS line_no FROM lined)"""
_SPANS = _CODED + r""", k AS (SELECT *, CASE language WHEN 'py' THEN regexp_matches(line, '^(?:(?:async\s+)?def|class)\b|^@') WHEN 'go' THEN regexp_matches(line, '^(?:func|type)\b') WHEN 'js' THEN regexp_matches(line, '^(?:async\s+)?function\b|^(?:abstract\s+)?class\b')
  ELSE regexp_matches(line, '^(?:async\s+)?function\b|^(?:abstract\s+)?class\b|^interface\b|^enum\b') END AS opens, regexp_matches(line, '^\S') AND NOT regexp_matches(line, '^(?:[}\])]|end\b|#)') AS at0 FROM coded WHERE language IN ('py', 'go', 'js', 'ts')),
k2 AS (SELECT *, CASE WHEN opens THEN 'definition' WHEN at0 THEN 'gap' END AS own FROM k),
k3 AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY repo_id, file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'gap') AS kind FROM k2),
k4 AS (SELECT *, (opens OR coalesce(lag(kind) OVER (PARTITION BY repo_id, file_path ORDER BY line_no), '') <> kind)::INT AS o FROM k3),
k5 AS (SELECT *, sum(o) OVER (PARTITION BY repo_id, file_path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS span FROM k4),
k6 AS (SELECT repo_id, file_path, span, min(line_no) AS a, max(line_no) AS z FROM k5 GROUP BY ALL),
k7 AS (SELECT *, unnest(range(CASE WHEN z - a + 1 <= 8 THEN 1 ELSE 1 + ceil((z - a + 1 - 8) / 6.0)::INT END)) AS i FROM k6),
k8 AS (SELECT repo_id, file_path, (a + i * 6)::INT AS start_line, least(a + i * 6 + 7, z)::INT AS end_line FROM k7),
defs AS (SELECT k8.repo_id, k8.file_path, start_line, end_line, string_agg(line, chr(10) ORDER BY line_no) AS content FROM k8 JOIN coded c ON c.repo_id = k8.repo_id AND c.file_path = k8.file_path AND line_no BETWEEN start_line AND end_line GROUP BY ALL HAVING regexp_matches(string_agg(line, chr(10) ORDER BY line_no), '\S'))"""


@query("c3_definition_chunks", f"WITH {_SPANS} SELECT repo_id, file_path, start_line, end_line, sha256(content) AS h FROM defs")
def c3(spark, d):
    return C.definition_chunks(source_texts(spark, d), 8, 2).select("repo_id", "file_path", "start_line", "end_line", F.sha2("content", 256).alias("h"))


@query("c4_chunk_files", f"""WITH {_SPANS}, w1 AS (SELECT repo_id, file_path, max(line_no) AS n FROM coded GROUP BY ALL), w2 AS (SELECT * FROM w1 ANTI JOIN defs USING (repo_id, file_path)),
w3 AS (SELECT *, unnest(range(CASE WHEN n <= 8 THEN 1 ELSE 1 + ceil((n - 8) / 6.0)::INT END)) AS i FROM w2)
SELECT repo_id, file_path, start_line, end_line FROM defs UNION ALL SELECT repo_id, file_path, (i * 6 + 1)::INT, least(i * 6 + 8, n)::INT FROM w3""")
def c4(spark, d):
    return C.chunk_files(source_texts(spark, d), 8, 2).select("repo_id", "file_path", "start_line", "end_line")


# --- analysis ----------------------------------------------------------------------------------------------------------

_LANGS = "langs AS (SELECT repo_id, lower(language) AS lang, sum(length(content))::BIGINT AS chars FROM chunks GROUP BY ALL)"


@query("a1_language_breakdown", f"WITH {X.CHUNKS}, {_LANGS} SELECT repo_id, lang, chars, round_even(100.0 * chars / greatest((sum(chars) OVER (PARTITION BY repo_id))::DOUBLE, 1), 2) AS pct FROM langs")
def a1(spark, d):
    return A.language_breakdown(X.chunks(spark, d))


def with_todos(spark, d):
    """Chunks in which each `le` of a text stands for a marker of open work."""
    return X.chunks(spark, d).withColumn("content", F.regexp_replace("content", P.ascii_words(r"\b(?:of|de|und)\b"), "todo"))


_TODO = r"(SELECT * REPLACE (regexp_replace(content, '\b(?:of|de|und)\b', 'todo', 'g') AS content) FROM chunks)"


@query("a2_todo_count", rf"WITH {X.CHUNKS} SELECT repo_id, sum(len(regexp_extract_all(content, '(?i)\b(TODO|FIXME)\b')))::BIGINT AS todo FROM {_TODO} GROUP BY repo_id")
def a2(spark, d):
    return A.todo_count(with_todos(spark, d))


@query("a3_long_chunks", f"WITH {X.CHUNKS} SELECT * FROM (SELECT repo_id, file_path, start_line, end_line - start_line + 1 AS length, row_number() OVER (PARTITION BY repo_id ORDER BY file_path, start_line, chunk_id) AS nth FROM chunks WHERE end_line - start_line + 1 > 7) WHERE nth <= 50")
def a3(spark, d):
    return A.long_chunks(X.chunks(spark, d), 7)


@query("a4_missing_tests", f"""WITH {X.CHUNKS}, p AS (SELECT DISTINCT repo_id || (length(file_path) % 2) AS repo_id, file_path FROM chunks WHERE NOT (length(file_path) % 2 = 0 AND contains(file_path, '/tests/')))
SELECT repo_id, file_path, nth FROM (SELECT *, bool_or(lower(file_path) LIKE '%/tests/%' OR lower(file_path) LIKE 'tests/%' OR contains(lower(file_path), 'test_')) OVER (PARTITION BY repo_id) AS t, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) AS nth FROM p) WHERE NOT t AND nth <= 20""")
def a4(spark, d):
    odd = F.length("file_path") % 2
    return A.missing_tests(X.chunks(spark, d).where(~((odd == 0) & F.col("file_path").contains("/tests/"))).withColumn("repo_id", F.concat("repo_id", odd.cast("string"))))


@query("a5_file_metrics", f"WITH {X.CHUNKS} SELECT repo_id, file_path, count(*) AS chunks, sum(end_line - start_line + 1)::BIGINT AS lines, min(language) AS language FROM chunks GROUP BY ALL")
def a5(spark, d):
    return A.file_metrics(X.chunks(spark, d))


@query("a6_quality_score", rf"""WITH {X.CHUNKS}, t AS (SELECT repo_id, sum(len(regexp_extract_all(content, '(?i)\b(TODO|FIXME)\b'))) AS todo FROM {_TODO} GROUP BY repo_id),
l AS (SELECT repo_id, least(50, count(*)) AS long FROM chunks WHERE end_line - start_line + 1 > 7 GROUP BY repo_id), b AS (SELECT repo_id, bool_or(lower(file_path) LIKE '%readme.md') AS readme, bool_or(contains(lower(file_path), '/tests/')) AS tested FROM chunks GROUP BY repo_id)
SELECT repo_id, least(100, greatest(0, 100 - least(30, todo) - least(30, 2 * coalesce(long, 0)) - CASE WHEN tested THEN 0 ELSE 20 END + CASE WHEN readme THEN 5 ELSE 0 END))::BIGINT AS quality_score FROM b JOIN t USING (repo_id) LEFT JOIN l USING (repo_id)""")
def a6(spark, d):
    return A.quality_score(with_todos(spark, d), 7)


@query("a7_top_contributors", "WITH c AS (SELECT 'r' || o_custkey % 50 AS repo_id, o_orderpriority || o_custkey % 7 AS author, count(*) AS commits FROM orders GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY commits DESC, author) AS nth FROM c) WHERE nth <= 10")
def a7(spark, d):
    return A.top_contributors(X.table(spark, d, "orders").selectExpr("concat('r', o_custkey % 50) repo_id", "concat(o_orderpriority, o_custkey % 7) author"))


_FACTS = f"""{X.CHUNKS}, {_LANGS}, top AS (SELECT repo_id, lang AS top_language FROM langs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY chars DESC, lang) = 1),
facts AS (SELECT repo_id, count(DISTINCT file_path) AS files, count(*) AS chunks, array_to_string(list_sort(list(DISTINCT file_path))[1:5], ', ') AS first_paths FROM chunks GROUP BY repo_id), {X.CODE_REPOS},
arch AS (SELECT repo_id, top_language, files, chunks, first_paths, 'Repository ' || full_name || ' (branch ' || default_branch || ') is primarily ' || top_language || '. The parse/index stage identified ' || files || ' source files and ' || chunks || ' chunks. Representative paths include: ' || first_paths || '. This summary is generated from structural chunk metadata and should be refined with LLM synthesis in later stages.' AS summary FROM facts JOIN top USING (repo_id) JOIN code_repos USING (repo_id))"""


@query("a8_architecture_facts", f"WITH {_FACTS} SELECT * FROM arch")
def a8(spark, d):
    return A.architecture_facts(X.chunks(spark, d), X.code_repositories(spark, d))


@query("a10_analyze_repos", rf"""WITH {_FACTS}, t AS (SELECT repo_id, sum(len(regexp_extract_all(content, '(?i)\b(TODO|FIXME)\b'))) AS todo, bool_or(lower(file_path) LIKE '%readme.md') AS readme, bool_or(contains(lower(file_path), '/tests/')) AS tested FROM chunks GROUP BY repo_id),
q AS (SELECT repo_id, least(100, greatest(0, 100 - least(30, todo) - CASE WHEN tested THEN 0 ELSE 20 END + CASE WHEN readme THEN 5 ELSE 0 END))::BIGINT AS quality_score FROM t)
SELECT r.repo_id, quality_score, summary, CASE WHEN summary IS NULL THEN 'NO_CHUNKS' END AS error_code FROM code_repos r LEFT JOIN q USING (repo_id) LEFT JOIN arch USING (repo_id)""")
def a10(spark, d):
    return A.analyze_repos(X.chunks(spark, d), X.code_repositories(spark, d))


# --- graph -------------------------------------------------------------------------------------------------------------


@query("g1_merge_file_text", f"WITH {X.CHUNKS} SELECT repo_id, file_path, sha256(string_agg(content, chr(10) ORDER BY start_line)) AS h FROM chunks WHERE content <> '' GROUP BY ALL")
def g1(spark, d):
    """Documents that share a path are joined in the order of their ids, as the rows lie in the table."""
    return G.merge_file_text(X.chunks(spark, d, "doc_id"), ("doc_id",)).select("repo_id", "file_path", F.sha2("content", 256).alias("h"))


@query("g2_extract_imports", f"""WITH {X.CODE}, r AS (SELECT repo_id, file_path, CASE WHEN py THEN 'src.f' || g ELSE CASE WHEN first THEN './f' || g ELSE '../src/f' || g END END AS ref, py FROM (SELECT repo_id, file_path, py, f // 2 AS g, true AS first FROM code UNION ALL SELECT repo_id, file_path, py, ('0x' || md5(text)[1:6])::BIGINT % (f + 1), false FROM code)
  UNION SELECT repo_id, file_path, 'os', py FROM code WHERE py)
SELECT DISTINCT repo_id, file_path, ref, CASE WHEN py THEN 'python' ELSE 'javascript' END AS kind FROM r""")
def g2(spark, d):
    return G.extract_imports(G.merge_file_text(X.code_files(spark, d)))


@query("g3_resolve_imports", f"WITH {X.CODE} SELECT DISTINCT r.repo_id, r.file_path AS source, t.file_path AS target, CASE WHEN r.py THEN 'python' ELSE 'javascript' END AS kind FROM refs r JOIN code t ON t.repo_id = r.repo_id AND t.py = r.py AND t.f = r.g")
def g3(spark, d):
    files = G.merge_file_text(X.code_files(spark, d))
    return G.resolve_imports(G.extract_imports(files), files).distinct()


@query("g4_dependency_graph", f"WITH {X.CODE} SELECT repo_id, source, target, kind, source || '->' || target AS id FROM edges")
def g4(spark, d):
    return G.dependency_edges(X.code_files(spark, d))


@query("g4_graph_stats", f"WITH {X.CODE} SELECT c.repo_id, c.nodes, coalesce(e.edges, 0) AS edges FROM (SELECT repo_id, count(*) AS nodes FROM code GROUP BY 1) c LEFT JOIN (SELECT repo_id, count(*) AS edges FROM edges GROUP BY 1) e USING (repo_id)")
def g4_stats(spark, d):
    return G.graph_stats(X.code_files(spark, d))


_BLAST = f"""{X.CODE}, changed AS (SELECT repo_id, file_path FROM code WHERE contains(text, '@')),
reach AS (SELECT repo_id, file_path FROM changed UNION SELECT e.repo_id, e.source FROM edges e JOIN reach r ON r.repo_id = e.repo_id AND r.file_path = e.target),
blast AS (SELECT repo_id, file_path FROM reach ANTI JOIN changed USING (repo_id, file_path))"""


@query("g5_blast_radius", f"WITH RECURSIVE {_BLAST} SELECT * FROM blast")
def g5(spark, d):
    code = X.code_files(spark, d)
    return G.blast_radius(G.dependency_edges(code), code.where("contains(content, '@')").select("repo_id", "file_path"))


# --- retrieval ---------------------------------------------------------------------------------------------------------

_STOP = _LIST(R.STOP_WORDS)
_INDEX = X.WHOLE + """, toks AS (SELECT repo_id, chunk_id, regexp_extract_all(lower(coalesce(file_path, '') || ' ' || coalesce(content, '')), '[a-z0-9_]+') AS t FROM whole),
pos AS (SELECT repo_id, chunk_id, unnest(t) AS term, unnest(range(len(t)))::INT AS pos FROM toks)"""
_LEX = f"""{_INDEX}, {X.QUESTIONS}, qt0 AS (SELECT query_id, repo_id, list_filter(list_distinct(regexp_extract_all(lower(q), '[a-z0-9_]+')), lambda t: t NOT IN ({_STOP})) AS ts FROM questions),
qt AS (SELECT query_id, repo_id, len(ts) AS n, unnest(ts) AS term FROM qt0),
hit AS (SELECT qt.query_id, qt.repo_id, chunk_id, n, term, pos FROM qt JOIN pos USING (repo_id, term)),
full_hit AS (SELECT query_id, repo_id, chunk_id FROM hit GROUP BY ALL HAVING count(DISTINCT term) = any_value(n)),
ends AS (SELECT h.query_id, h.repo_id, h.chunk_id, h.n, h.pos AS e, t.term, max(t.pos) AS latest FROM hit h JOIN full_hit USING (query_id, repo_id, chunk_id) JOIN hit t ON t.query_id = h.query_id AND t.repo_id = h.repo_id AND t.chunk_id = h.chunk_id AND t.pos <= h.pos GROUP BY ALL),
cover AS (SELECT query_id, repo_id, chunk_id, e, min(latest) AS s FROM ends GROUP BY query_id, repo_id, chunk_id, e, n HAVING count(*) = n),
mincover AS (SELECT query_id, repo_id, chunk_id, s, min(e) AS e FROM cover GROUP BY ALL),
lexscore AS (SELECT query_id, repo_id, chunk_id, round_even(sum(least(1.0, 16e0 / (e - s + 1))), 6) AS score FROM mincover GROUP BY ALL),
lex AS (SELECT * FROM (SELECT l.*, w.file_path, w.start_line, w.end_line, w.language, row_number() OVER (PARTITION BY query_id, repo_id ORDER BY score DESC, file_path, start_line NULLS LAST, chunk_id) AS rank FROM lexscore l JOIN whole w USING (repo_id, chunk_id)) WHERE rank <= 10)"""
_COS = "list_dot_product(a.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"
_DENSE = f"""dense AS (SELECT * FROM (SELECT a.query_id, a.repo_id, v.chunk_id, round_even({_COS}, 4) AS score, row_number() OVER (PARTITION BY a.query_id, a.repo_id ORDER BY round_even({_COS}, 4) DESC, v.chunk_id) AS rank
  FROM questions a JOIN vectors v USING (repo_id) WHERE a.embedding IS NOT NULL) WHERE rank <= 10)"""


@query("r1_build_lexical_index", f"WITH {_INDEX} SELECT repo_id, term, chunk_id, count(*) AS n, min(pos) AS first, sum(pos)::BIGINT AS total FROM pos GROUP BY ALL")
def r1(spark, d):
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return R.build_lexical_index(X.whole(spark, d)).select("repo_id", "term", "chunk_id", F.size("positions").cast("long").alias("n"), F.get("positions", F.lit(0)).alias("first"), total.alias("total"))


def lexical(spark, d):
    chunks, asked = X.whole(spark, d), X.questions(spark, d)
    return R.lexical_search(S.durable(R.index_of_terms(chunks, asked), "index"), chunks, asked, 10)


@query("r2_lexical_search", f"WITH {_LEX} SELECT query_id, repo_id, chunk_id, score, rank FROM lex")
def r2(spark, d):
    return lexical(spark, d).select("query_id", "repo_id", "chunk_id", "score", "rank")


@query("r3_dense_search", f"""WITH a AS (SELECT vec_id AS query_id, label AS repo_id, embedding FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT label AS repo_id, vec_id::VARCHAR AS chunk_id, embedding FROM embeddings)
SELECT * FROM (SELECT query_id, repo_id::VARCHAR AS repo_id, chunk_id, round_even({_COS}, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round_even({_COS}, 4) DESC, chunk_id) AS rank FROM a JOIN v USING (repo_id)) WHERE rank <= 5""")
def r3(spark, d):
    e = X.table(spark, d, "embeddings").withColumn("repo_id", F.col("label").cast("string"))
    return R.dense_search(e.select("repo_id", F.col("vec_id").cast("string").alias("chunk_id"), "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "repo_id", "embedding"), 5)


@query("r3_approximate_search")
def r3_approximate(spark, d):
    """The questions of r3_dense_search, among hashed vectors, with as many probes as a sample of them needs for 95 % of the exact results."""
    e = X.table(spark, d, "embeddings").withColumn("repo_id", F.col("label").cast("string"))
    vectors, asked = e.select("repo_id", F.col("vec_id").cast("string").alias("chunk_id"), "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "repo_id", "embedding")
    first = vectors.select(F.size("embedding")).first()
    dim = first[0] if first else 1
    return N.approximate_search(vectors, N.build_vector_index(vectors, dim), asked, dim, N.fit_probes(vectors, asked, dim), 10)


@query("r4_min_max_normalize", "SELECT event_id, CASE WHEN max(value) OVER w = min(value) OVER w THEN 1.0 ELSE round_even((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) END AS v FROM events WINDOW w AS (PARTITION BY user_id)")
def r4(spark, d):
    from pyspark.sql.window import Window

    return X.table(spark, d, "events").select("event_id", F.bround(R.min_max(F.col("value"), Window.partitionBy("user_id")), 6).alias("v"))


@query("r5_path_term_overlap", f"WITH {X.WHOLE}, t AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(file_path || ' ' || language), '[a-z0-9_]+')) AS a FROM whole) SELECT chunk_id, round_even(len(list_intersect(['src', 'py', 'app'], a)) / 3e0, 6) AS overlap FROM t")
def r5(spark, d):
    return X.whole(spark, d).select("chunk_id", F.bround(R.path_overlap(F.lit("src py app"), F.col("file_path"), F.col("language")), 6).alias("overlap"))


_HYBRID = f"""{_LEX}, {X.VECTORS}, {_DENSE}, both_sides AS (SELECT query_id, repo_id, chunk_id, coalesce(l.score, 0) AS lexical, coalesce(n.score, 0) AS dense FROM lex l FULL JOIN dense n USING (query_id, repo_id, chunk_id)),
known AS (SELECT b.*, w.file_path, w.start_line, w.end_line, w.language, q.q FROM both_sides b LEFT JOIN whole w USING (repo_id, chunk_id) JOIN questions q USING (query_id, repo_id)),
fused0 AS (SELECT *, CASE WHEN max(lexical) OVER w = min(lexical) OVER w THEN 1e0 ELSE (lexical - min(lexical) OVER w) / (max(lexical) OVER w - min(lexical) OVER w) END AS nl, CASE WHEN max(dense) OVER w = min(dense) OVER w THEN 1e0 ELSE (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) END AS nd,
  list_distinct(regexp_extract_all(lower(q), '[a-z0-9_]+')) AS qs, regexp_extract_all(lower(file_path || ' ' || language), '[a-z0-9_]+') AS ps FROM known WINDOW w AS (PARTITION BY query_id, repo_id)),
fused AS (SELECT *, round_even(5e-1 * nd + 4e-1 * nl + 1e-1 * CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, ps)) / len(qs)::DOUBLE ELSE 0 END, 6) AS score FROM fused0),
hybrid AS (SELECT * FROM (SELECT query_id, repo_id, chunk_id, file_path, start_line, end_line, language, score, q, row_number() OVER (PARTITION BY query_id, repo_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= 5)"""


def hybrid(spark, d, limit=5):
    chunks, asked = X.whole(spark, d), X.questions(spark, d)
    return R.hybrid_search(lexical(spark, d), R.dense_search(X.vectors(spark, d), asked, 10), chunks, asked, limit)


_RANKED = _HYBRID.replace("WHERE rank <= 5)", "WHERE rank <= 20)").replace("hybrid AS (", "ranked AS (")


def ranked(spark, d):
    """Search results of the questions."""
    return hybrid(spark, d, 20)


@query("r6_hybrid_search", f"WITH {_HYBRID} SELECT query_id, repo_id, chunk_id, file_path, score, rank FROM hybrid")
def r6(spark, d):
    return hybrid(spark, d).select("query_id", "repo_id", "chunk_id", "file_path", "score", "rank")


@query("r7_hydrate_content", f"WITH {_RANKED} SELECT r.query_id, r.repo_id, r.chunk_id, r.rank, sha256(c.content) AS h FROM ranked r LEFT JOIN whole c USING (repo_id, chunk_id)")
def r7(spark, d):
    return R.hydrate_content(ranked(spark, d), X.whole(spark, d)).select("query_id", "repo_id", "chunk_id", "rank", F.sha2("content", 256).alias("h"))


@query("r8_rerank", f"""WITH {_RANKED}, s AS (SELECT h.*, list_distinct(regexp_extract_all(lower(h.q), '[a-z0-9_]+')) AS qs, regexp_extract_all(lower(h.file_path || chr(10) || h.language || chr(10) || w.content), '[a-z0-9_]+') AS ts FROM ranked h JOIN whole w USING (repo_id, chunk_id)),
n AS (SELECT *, CASE WHEN rank <= 3 THEN CASE WHEN len(qs) > 0 THEN round_even(len(list_intersect(qs, ts)) / len(qs)::DOUBLE, 6) ELSE 0 END ELSE score END AS s2 FROM s)
SELECT * FROM (SELECT query_id, repo_id, chunk_id, s2 AS score, row_number() OVER (PARTITION BY query_id, repo_id ORDER BY s2 DESC, chunk_id) AS rank FROM n) WHERE rank <= 5""")
def r8(spark, d):
    """All merged candidates; three of a question are scored anew, and the first five are kept then."""
    found = R.hydrate_content(ranked(spark, d), X.whole(spark, d))
    return R.rerank(found, X.questions(spark, d), 3).where("rank <= 5").select("query_id", "repo_id", "chunk_id", "score", "rank")


@query("r9_diverse_select", f"""WITH {_RANKED}, o AS (SELECT *, file_path AS p FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, repo_id, file_path ORDER BY rank) = 1),
w AS (SELECT *, {_WEIGHT} AS weight FROM o), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, repo_id, string_split(file_path, '/')[1] ORDER BY weight, rank) AS k FROM w),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, repo_id ORDER BY weight, rank) AS place FROM f WHERE k <= 2), a2 AS (SELECT query_id, repo_id, chunk_id, file_path, 1 AS phase, place FROM a WHERE place <= 6),
u AS (SELECT * FROM a2 UNION ALL SELECT query_id, repo_id, chunk_id, file_path, 2, rank FROM ranked ANTI JOIN a2 USING (query_id, repo_id, chunk_id))
SELECT query_id, repo_id, chunk_id, file_path, pick FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repo_id ORDER BY phase, place) AS pick FROM u) WHERE pick <= 6""")
def r9(spark, d):
    return R.diverse_select(ranked(spark, d), 6)


# --- grounding ---------------------------------------------------------------------------------------------------------

_MODULE = "CASE WHEN d[1] IN ('src', 'app', 'lib', 'packages') AND len(d) > 1 THEN d[1] || '/' || d[2] ELSE d[1] END"
_NAME = "CASE language WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'go' THEN 'Go' WHEN 'md' THEN 'Markdown' WHEN 'js' THEN 'JavaScript' END"
_FACETS = f"""{_RANKED}, parts AS (SELECT *, string_split(file_path, '/') AS d FROM ranked WHERE rank <= 8),
mods AS (SELECT query_id, repo_id, {_MODULE} AS m, min(rank) AS r FROM parts GROUP BY ALL), mods2 AS (SELECT query_id, repo_id, list(m ORDER BY r)[1:5] AS modules FROM mods GROUP BY ALL),
names AS (SELECT query_id, repo_id, {_NAME} AS name, min(rank) AS r FROM ranked GROUP BY ALL), names2 AS (SELECT query_id, repo_id, list(name ORDER BY r) AS languages FROM names GROUP BY ALL),
hints AS (SELECT query_id, repo_id, bool_or(regexp_matches(lower(file_path), 'cli|argparse|typer')) AS cli, bool_or(regexp_matches(lower(file_path), 'api|route|controller')) AS api, bool_or(regexp_matches(lower(file_path), 'service|core|engine')) AS core FROM parts GROUP BY ALL),
facets AS (SELECT query_id, repo_id, modules, languages, [x FOR x IN [CASE WHEN cli THEN 'CLI entrypoint receives arguments' END, CASE WHEN api THEN 'request handlers call service modules' END, CASE WHEN core THEN 'core modules execute main business logic' END] IF x IS NOT NULL] AS flows FROM mods2 JOIN names2 USING (query_id, repo_id) JOIN hints USING (query_id, repo_id))"""


@query("a9_repo_summary_facets", f"WITH {_FACETS} SELECT query_id, repo_id, array_to_string(modules, ',') AS modules, array_to_string(languages, ',') AS languages, '' AS outputs, array_to_string(flows, ',') AS flows FROM facets")
def a9(spark, d):
    return A.repo_summary_facets(ranked(spark, d)).select("query_id", "repo_id", *[F.array_join(c, ",").alias(c) for c in ("modules", "languages", "outputs", "flows")])


_CITED = f"{_RANKED}, cited AS (SELECT query_id, repo_id, rank, chunk_id, file_path, start_line AS line_start, greatest(end_line, 1) AS line_end, file_path || '#L' || start_line || '-L' || greatest(end_line, 1) AS anchor, score FROM ranked WHERE rank <= 3)"


@query("k1_format_citations", f"WITH {_CITED} SELECT * FROM cited")
def k1(spark, d):
    return K.format_citations(ranked(spark, d))


def stretched(spark, d):
    """Citations of which those of rank 2 reach beyond their chunk."""
    return K.format_citations(ranked(spark, d)).withColumn("line_end", F.col("line_end") + F.expr("if(rank = 2, 3, 0)"))


_VALID = f"{_CITED}, valid AS (SELECT * FROM cited WHERE rank <> 2)"


@query("k2_validate_citations", f"WITH {_VALID} SELECT query_id, repo_id, chunk_id, file_path, line_start, line_end FROM valid")
def k2(spark, d):
    return K.validate_citations(stretched(spark, d), X.whole(spark, d)).select("query_id", "repo_id", "chunk_id", "file_path", "line_start", "line_end")


@query("k3_no_citation_flag", f"WITH {_VALID} SELECT q.query_id, q.repo_id, NOT EXISTS (SELECT 1 FROM valid v WHERE v.query_id = q.query_id AND v.repo_id = q.repo_id AND v.rank = 3) AS no_citation FROM questions q")
def k3(spark, d):
    return K.no_citation_flag(X.questions(spark, d), K.validate_citations(stretched(spark, d), X.whole(spark, d)).where("rank = 3"))


def asked_kinds(spark, d):
    """The questions, each followed by one of three kinds, and one of a repository without any code."""
    q = F.expr("concat(q, element_at(array(', in which languages?', ', as a summary', ', and where is it?'), cast(pmod(query_id, 3) as int) + 1))")
    return X.questions(spark, d).select("query_id", "repo_id", q.alias("q")).union(spark.sql("select -1L, 'empty', 'give a summary'"))


@query("k4_answer_plan", f"""WITH {_FACETS}, a AS (SELECT query_id, repo_id, q || [', in which languages?', ', as a summary', ', and where is it?'][query_id % 3 + 1] AS q FROM questions UNION ALL SELECT -1, 'empty', 'give a summary'),
refs AS (SELECT query_id, repo_id, string_agg(file_path || ':1', ', ' ORDER BY rank) AS refs FROM ranked WHERE rank IN (1, 3) GROUP BY ALL),
p AS (SELECT a.*, f.modules, f.flows, f.languages, r.refs, CASE WHEN modules IS NULL THEN 'no_results' WHEN regexp_matches(lower(q), '{alternatives(P.LANGUAGE_QUESTIONS)}') AND len(languages) > 0 THEN 'language' WHEN regexp_matches(lower(q), '{alternatives(P.SUMMARY_QUESTIONS)}') THEN 'summary' ELSE 'model' END AS plan FROM a LEFT JOIN facets f USING (query_id, repo_id) LEFT JOIN refs r USING (query_id, repo_id))
SELECT query_id, repo_id, plan, coalesce(array_to_string(languages[1:8], ', '), '') AS languages, CASE plan WHEN 'no_results' THEN 'I could not find relevant indexed code context for that query.'
WHEN 'language' THEN CASE WHEN len(languages) = 1 THEN 'The indexed code appears to be primarily ' ELSE 'The indexed code appears to use: ' END || array_to_string(languages[1:8], ', ') || '. Evidence from: ' || coalesce(refs, 'no exact anchor') || '.'
WHEN 'summary' THEN '- Purpose: Codebase for o/' || repo_id || '.' || chr(10) || '- Core modules: ' || array_to_string(modules, ', ') || '.' || chr(10) || '- Runtime flow: ' || CASE WHEN len(flows) > 0 THEN array_to_string(flows, '; ') || '.' ELSE 'entrypoint initializes modules, then feature components/services process the main workflow.' END
  || chr(10) || '- Output formats: runtime artifacts inferred from code paths.' || chr(10) || '- Primary languages: ' || array_to_string(languages[1:6], ', ') || '.' END AS text FROM p""")
def k4(spark, d):
    valid = K.validate_citations(stretched(spark, d), X.whole(spark, d))
    return K.answer_plan(asked_kinds(spark, d), ranked(spark, d), valid, X.code_repositories(spark, d), spark.createDataFrame([], "repo_id string, summary string"))


@query("k5_build_contexts", f"WITH {_RANKED} SELECT r.query_id, r.repo_id, sum(length(substring(c.content, 1, 100)))::BIGINT AS chars, count(*) AS n, string_agg(r.file_path, ',' ORDER BY rank) AS paths FROM ranked r JOIN whole c USING (repo_id, chunk_id) WHERE rank <= 6 GROUP BY ALL")
def k5(spark, d):
    made = K.build_contexts(R.hydrate_content(ranked(spark, d), X.whole(spark, d)), 6, 100)
    items = made.select("query_id", "repo_id", F.from_json("contexts", "array<struct<rank:int,file_path:string,content:string>>").alias("c"))
    return items.select("query_id", "repo_id", F.aggregate(F.transform("c", lambda x: F.length(x["content"])), F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"), F.size("c").cast("long").alias("n"), F.array_join(F.transform("c", lambda x: x["file_path"]), ",").alias("paths"))


@query("k6_snippet_answer", rf"""WITH {_RANKED}, s AS (SELECT r.query_id, r.repo_id, rank, r.file_path || ':' || r.start_line AS place, substring(trim(regexp_replace(c.content, '{P.SPACES}', ' ', 'g')), 1, 120) AS preview FROM ranked r JOIN whole c USING (repo_id, chunk_id) WHERE rank <= 3)
SELECT query_id, repo_id, 'Based on indexed code context: ' || string_agg(CASE WHEN preview <> '' THEN place || ' -> ' || preview ELSE place END, ' | ' ORDER BY rank) || '.' AS answer FROM s GROUP BY ALL""")
def k6(spark, d):
    return K.snippet_answer(R.hydrate_content(ranked(spark, d), X.whole(spark, d)))


@query("k7_suggested_questions", f"""WITH {X.CHUNKS}, p AS (SELECT repo_id, file_path, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) AS n FROM (SELECT DISTINCT repo_id, file_path FROM chunks))
SELECT repo_id, i AS nth, q AS question FROM (SELECT DISTINCT repo_id FROM chunks), (VALUES (1, 'What are the main architecture components in this repository?'), (2, 'Where is authentication and token handling implemented?'), (3, 'Which files show the core business logic flow?')) v(i, q)
UNION ALL SELECT repo_id, n + 3, 'Explain the responsibilities of `' || file_path || '`.' FROM p WHERE n <= 2""")
def k7(spark, d):
    return K.suggested_questions(X.chunks(spark, d), 5)


@query("k8_session_list", f"WITH {X.SESSIONS} SELECT s.session_id, s.user_id, s.repo_id, s.created_at, count(m.session_id) AS messages, substring(max_by(m.content, m.turn), 1, 120) AS preview FROM sessions s LEFT JOIN messages m USING (session_id) GROUP BY ALL")
def k8(spark, d):
    return K.session_list(*X.sessions(spark, d))


@query("k9_session_history", f"WITH {X.SESSIONS} SELECT m.session_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS history FROM messages m JOIN sessions s USING (session_id) WHERE user_id = 'u3' GROUP BY ALL")
def k9(spark, d):
    return K.session_history(*X.sessions(spark, d), "u3")


@query("k10_delete_sessions", f"WITH {X.SESSIONS} SELECT m.session_id, count(*) AS n FROM messages m JOIN sessions s USING (session_id) WHERE NOT (user_id = 'u3' AND session_id::INT % 2 = 1) GROUP BY 1")
def k10(spark, d):
    sessions, messages = X.sessions(spark, d)
    return K.delete_sessions(sessions, messages, sessions.where("cast(session_id as int) % 2 = 1"), "u3")[1].groupBy("session_id").agg(F.count("*").alias("n"))


# --- diffs -------------------------------------------------------------------------------------------------------------


@query("d1_diff_files", f"WITH {X.DIFFS} SELECT repo_id, head_sha, file_no::BIGINT AS file_no, path, status, added, removed, sha256(array_to_string(coalesce(plus, []), chr(10))) AS h FROM df")
def d1(spark, d):
    return D.diff_files(X.diffs(spark, d)).select("repo_id", "head_sha", F.col("file_no").cast("long").alias("file_no"), "path", "status", "added", "removed", F.sha2(F.array_join("added_lines", "\n"), 256).alias("h"))


@query("d2_diff_hunks", f"WITH {X.DIFFS} SELECT repo_id, head_sha, path, hs AS \"start\", he AS \"end\" FROM df")
def d2(spark, d):
    return D.diff_files(X.diffs(spark, d)).select("repo_id", "head_sha", "path", F.explode("hunks").alias("h")).select("repo_id", "head_sha", "path", "h.start", "h.end")


_TOUCH = X.DIFFS + ", dt AS (SELECT *, path || chr(10) || array_to_string(coalesce(plus, []), chr(10)) AS t FROM df), touch AS (SELECT repo_id, head_sha, file_no, path, list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{n}' END" for n, p in D.SECURITY_PATTERNS.items()) + "], lambda x: x IS NOT NULL)) AS categories FROM dt)"


@query("d3_security_touches", f"WITH {_TOUCH} SELECT repo_id, head_sha, path, array_to_string(categories, ',') AS categories FROM touch WHERE len(categories) > 0")
def d3(spark, d):
    return D.security_touches(D.diff_files(X.diffs(spark, d))).withColumn("categories", F.array_join("categories", ","))


@query("d4_diff_summary", f"WITH {X.DIFFS} SELECT repo_id, head_sha, path, status, added, removed, 1 AS hunks FROM df")
def d4(spark, d):
    return D.diff_summary(D.diff_files(X.diffs(spark, d)))


@query("d5_diff_contexts", f"WITH {X.DIFFS} SELECT repo_id, head_sha, file_no AS rank, path, hs AS line_start, he AS line_end, sha256(array_to_string(coalesce(plus, [])[1:60], chr(10))) AS h FROM df")
def d5(spark, d):
    return D.diff_contexts(D.diff_files(X.diffs(spark, d))).select("repo_id", "head_sha", "rank", "path", "line_start", "line_end", F.sha2("content", 256).alias("h"))


_CODE_TOUCH = _TOUCH.replace("source AS repo_id", "['src0', 'src1', 'src2', 'src3'][doc_id % 4 + 1] AS repo_id").replace("'auth/f' || doc_id || '.py'", "'src/f' || (doc_id // 4) || CASE WHEN doc_id % 8 < 4 THEN '.py' ELSE '.ts' END")


@query("d6_commit_report", f"""WITH RECURSIVE {_CODE_TOUCH}, {X.CODE}, newest AS (SELECT repo_id, head_sha FROM dl QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY doc_id * 7919 % 1009 DESC, head_sha DESC) = 1),
changed AS (SELECT df.repo_id, df.path AS file_path FROM df JOIN newest USING (repo_id, head_sha)),
reach AS (SELECT repo_id, file_path FROM changed UNION SELECT e.repo_id, e.source FROM edges e JOIN reach r ON r.repo_id = e.repo_id AND r.file_path = e.target),
blast AS (SELECT repo_id, count(*) AS n FROM reach ANTI JOIN changed USING (repo_id, file_path) GROUP BY repo_id)
SELECT t.repo_id, t.head_sha, count(*) AS changed, sum(df.added)::BIGINT AS added, sum(df.removed)::BIGINT AS removed, count(*) FILTER (len(categories) > 0) AS flagged, coalesce((SELECT n FROM blast b WHERE b.repo_id = t.repo_id), 0) AS impacted
FROM touch t JOIN newest USING (repo_id, head_sha) JOIN df ON df.head_sha = t.head_sha AND df.file_no = t.file_no GROUP BY ALL""")
def d6(spark, d):
    """The newest diff of each code repository; it changes the code file of its document's number."""
    made = X.diffs(spark, d, "element_at(array('src0', 'src1', 'src2', 'src3'), cast(doc_id % 4 as int) + 1)", "concat('src/f', doc_id div 4, if(doc_id % 8 < 4, '.py', '.ts'))", "doc_id * 7919 % 1009")
    return D.commit_report(D.diff_files(S.latest_commit_diff(made)), G.dependency_edges(X.code_files(spark, d)))


@query("d7_diff_fallback_answer", f"""WITH {_TOUCH}, c AS (SELECT head_sha, array_to_string(list_sort(list_distinct(flatten(list(categories)))), ', ') AS categories, string_agg(path, ', ' ORDER BY file_no) AS paths, any_value(repo_id) AS repo_id FROM touch GROUP BY head_sha)
SELECT repo_id, head_sha, categories, 'This commit (' || head_sha[1:10] || ') changed: ' || paths || '.' || CASE WHEN categories <> '' THEN ' Security-sensitive areas: ' || categories || '.' ELSE '' END AS answer FROM c
UNION ALL SELECT 'empty', '0123456789abcdef', '', 'This commit (0123456789) changed: no files.'""")
def d7(spark, d):
    diffs = X.diffs(spark, d).select("repo_id", "head_sha", "diff_text").union(spark.sql("select 'empty', '0123456789abcdef', ''"))
    return D.diff_fallback_answer(diffs, D.diff_files(diffs))


# --- jobs --------------------------------------------------------------------------------------------------------------


@query("j1_latest_job", f"WITH {X.JOBS} SELECT repo_id, job_id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, job_id DESC) = 1")
def j1(spark, d):
    return J.latest_job(X.jobs(spark, d)).select("repo_id", "job_id", "status")


@query("j2_status_events", f"""WITH {X.JOBS} SELECT job_id, CASE status WHEN 'failed' THEN 'error' WHEN 'done' THEN 'done' ELSE 'progress' END AS event, CASE WHEN status = 'failed' THEN CASE WHEN contains(error_message, ':') THEN 'CLONE_TIMEOUT' ELSE 'UNKNOWN' END END AS code,
CASE WHEN status = 'failed' THEN CASE WHEN contains(error_message, ':') THEN 'no answer: twice' ELSE error_message END WHEN status = 'done' THEN 'done' ELSE status || ' in progress' END AS message, CASE WHEN status = 'done' OR status = 'failed' AND progress = 0 THEN 100 ELSE progress END AS progress FROM jobs""")
def j2(spark, d):
    return J.status_events(X.jobs(spark, d))


def history(spark, d):
    """State histories: the events of one user are the states of one job."""
    return X.jobs(spark, d).select(F.col("repo_id").alias("job_id"), "event_id", F.expr("case when event_id % 97 = 0 then 'done' else element_at(array('queued', 'parsing'), cast(event_id div 400 % 2 as int) + 1) end").alias("status"), F.lit(0).alias("progress"), F.lit(None).cast("string").alias("error_message"), "ts")


@query("j3_status_changes", """WITH h AS (SELECT user_id::VARCHAR AS job_id, event_id, ts, CASE WHEN event_id % 97 = 0 THEN 'done' ELSE ['queued', 'parsing'][event_id // 400 % 2 + 1] END AS status FROM events),
m AS (SELECT *, lag(status) OVER w AS was, coalesce(bool_or(status = 'done') OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM h WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
SELECT job_id, event_id, status, 0 AS progress FROM m WHERE NOT ended AND (was IS NULL OR was <> status)""")
def j3(spark, d):
    return J.status_changes(history(spark, d))


@query("j4_due_jobs", f"""WITH {X.JOBS}, {X.REPOS}, r AS (SELECT *, CASE WHEN status IN ('queued', 'parsing') THEN 'parse' WHEN status = 'embedding' THEN 'embed' WHEN status = 'analyzing' THEN 'analyze' END AS stage FROM jobs JOIN repositories USING (repo_id))
SELECT * FROM (SELECT stage, row_number() OVER (PARTITION BY stage ORDER BY created_at, job_id) AS nth, job_id, repo_id FROM r WHERE stage IS NOT NULL AND (next_retry_at IS NULL OR next_retry_at <= {DNOW})) WHERE nth <= 5""")
def j4(spark, d):
    return J.due_jobs(X.jobs(spark, d), X.repositories(spark, d), now(), 5)


def failures(spark, d):
    code = F.expr("element_at(array('CLONE_TIMEOUT', 'EMBED_UPSERT_FAILED', 'CLONE_FAILED', 'UNEXPECTED_X', 'NO_CHUNKS'), cast(event_id % 5 as int) + 1)")
    stage = F.expr("element_at(array('parsing', 'embedding', 'analyzing'), cast(event_id % 3 as int) + 1)")
    return X.jobs(spark, d).select("job_id", "repo_id", stage.alias("stage"), code.alias("error_code"), F.concat(F.lit("m"), "repo_id").alias("message"), F.expr("event_id % 4").alias("retry_count"))


_FAILED = """f AS (SELECT event_id::VARCHAR AS job_id, user_id::VARCHAR AS repo_id, ['parsing', 'embedding', 'analyzing'][event_id % 3 + 1] AS stage, ['CLONE_TIMEOUT', 'EMBED_UPSERT_FAILED', 'CLONE_FAILED', 'UNEXPECTED_X', 'NO_CHUNKS'][event_id % 5 + 1] AS code, event_id % 4 AS n FROM events),
a AS (SELECT *, (code LIKE '%TIMEOUT' OR (stage = 'embedding' AND code = 'EMBED_UPSERT_FAILED') OR (stage = 'parsing' AND code IN ('CLONE_FAILED', 'CLONE_TIMEOUT')) OR code LIKE 'UNEXPECTED%') AND n < 3 AS again FROM f)"""


@query("j5_route_failures", f"""WITH {_FAILED} SELECT job_id, CASE WHEN again THEN stage ELSE 'failed' END AS status, CASE WHEN NOT again THEN 100 END AS progress, code || ': m' || repo_id AS error_message, CASE WHEN again THEN n + 1 ELSE n END AS retry_count,
CASE WHEN again THEN {DNOW} + to_seconds((30 * 2 ** n)::INT) END AS next_retry_at, CASE WHEN NOT again THEN {DNOW} END AS completed_at, NOT again AS dead_letter FROM a""")
def j5(spark, d):
    return J.route_failures(failures(spark, d), now())


@query("j5_dead_letters", f"WITH {_FAILED} SELECT job_id, repo_id, stage, code AS error_code, 'm' || repo_id AS error_message, n AS attempt_count FROM a WHERE NOT again")
def j5_dead(spark, d):
    return J.dead_letters(failures(spark, d))


def submissions(spark, d):
    return X.table(spark, d, "orders").selectExpr("o_orderkey as request_id", "cast(o_custkey % 300 as string) repo_id", "concat('c', o_orderkey % 4) commit_sha", "if(o_orderkey % 7 = 0, '', concat('k', o_orderkey % 6)) idempotency_key", "o_orderkey % 9 = 0 as force", "cast(o_orderdate as timestamp) ts")


@query("j6_dedupe_requests", f"""WITH RECURSIVE {X.JOBS}, q0 AS (SELECT o_orderkey AS request_id, (o_custkey % 300)::VARCHAR AS repo_id, 'c' || o_orderkey % 4 AS commit_sha, CASE WHEN o_orderkey % 7 <> 0 THEN 'k' || o_orderkey % 6 END AS idempotency_key, o_orderkey % 9 = 0 AS force, o_orderdate AS ts FROM orders),
k AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY repo_id, commit_sha, idempotency_key ORDER BY created_at DESC, job_id DESC) = 1), c AS (SELECT * FROM jobs WHERE status <> 'failed' QUALIFY row_number() OVER (PARTITION BY repo_id, commit_sha ORDER BY created_at DESC, job_id DESC) = 1),
q AS (SELECT q0.*, k.job_id AS kj, k.status = 'done' AS kd, c.job_id AS cj, c.status = 'done' AS cd, row_number() OVER (PARTITION BY q0.repo_id, q0.commit_sha ORDER BY q0.ts, q0.request_id) AS i
  FROM q0 LEFT JOIN k USING (repo_id, commit_sha, idempotency_key) LEFT JOIN c ON c.repo_id = q0.repo_id AND c.commit_sha = q0.commit_sha),
r AS (SELECT repo_id, commit_sha, i, request_id, CASE WHEN force OR coalesce(kj, cj) IS NULL THEN 'job-' || request_id ELSE coalesce(kj, cj) END AS job_id, NOT force AND coalesce(CASE WHEN kj IS NOT NULL THEN kd ELSE cd END, false) AS cache_hit, force OR coalesce(kj, cj) IS NULL AS created,
    CASE WHEN force OR coalesce(kj, cj) IS NULL THEN 'job-' || request_id END AS made, CASE WHEN (force OR coalesce(kj, cj) IS NULL) AND idempotency_key IS NOT NULL THEN '|' || idempotency_key || '=job-' || request_id || '|' ELSE '' END AS keys FROM q WHERE i = 1
  UNION ALL SELECT q.repo_id, q.commit_sha, q.i, q.request_id, CASE WHEN f THEN 'job-' || q.request_id ELSE found END, NOT f AND contains(own, 'none') AND coalesce(CASE WHEN q.kj IS NOT NULL THEN q.kd WHEN r.made IS NULL THEN q.cd END, false), f,
    CASE WHEN f THEN 'job-' || q.request_id ELSE r.made END, CASE WHEN f AND q.idempotency_key IS NOT NULL THEN '|' || q.idempotency_key || '=job-' || q.request_id || '|' || r.keys ELSE r.keys END
  FROM r JOIN q ON q.repo_id = r.repo_id AND q.commit_sha = r.commit_sha AND q.i = r.i + 1,
    LATERAL (SELECT CASE WHEN q.idempotency_key IS NOT NULL AND contains(r.keys, '|' || q.idempotency_key || '=') THEN regexp_extract(r.keys, '[|]' || q.idempotency_key || '=([^|]*)[|]', 1) ELSE 'none' END AS own) o,
    LATERAL (SELECT coalesce(nullif(own, 'none'), q.kj, r.made, q.cj) AS found) g, LATERAL (SELECT q.force OR found IS NULL AS f) h)
SELECT request_id, job_id, cache_hit, created FROM r""")
def j6(spark, d):
    return J.dedupe_requests(submissions(spark, d), X.jobs(spark, d))


def requests(spark, d):
    return X.table(spark, d, "events").select(F.col("event_type").alias("scope"), F.expr("if(event_id % 3 = 0, 'guest', 'auth')").alias("identity_type"), F.col("user_id").cast("string").alias("identity"), F.col("event_id").alias("request_id"), "ts")


@query("j7_rate_limit_audit", """WITH RECURSIVE o AS (SELECT event_type AS scope, CASE WHEN event_id % 3 = 0 THEN 'guest' ELSE 'auth' END AS identity_type, user_id::VARCHAR AS identity, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type, event_id % 3 = 0, user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
r AS (SELECT scope, identity_type, identity, event_id, i, us AS start, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT o.scope, o.identity_type, o.identity, o.event_id, o.i, CASE WHEN o.us >= r.start + 864000000000 THEN o.us ELSE r.start END, CASE WHEN o.us >= r.start + 864000000000 THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.scope = r.scope AND o.identity_type = r.identity_type AND o.identity = r.identity AND o.i = r.i + 1)
SELECT scope, identity_type, identity, event_id AS request_id, n <= CASE identity_type WHEN 'auth' THEN 4 ELSE 2 END AS allowed, greatest(CASE identity_type WHEN 'auth' THEN 4 ELSE 2 END - n, 0) AS remaining FROM r""")
def j7(spark, d):
    return J.rate_limit_audit(requests(spark, d), {"auth": 4, "guest": 2}, 864_000)


@query("j8_stage_progress", "WITH b AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey::VARCHAR AS job_id, l_linenumber AS batch_no, least(95, 40 + floor(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) * 50 / sum(n) OVER (PARTITION BY l_orderkey)))::INT AS progress FROM b")
def j8(spark, d):
    batches = X.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("n"))
    return J.stage_progress(batches.selectExpr("cast(l_orderkey as string) job_id", "l_linenumber batch_no", "n", "sum(n) over (partition by l_orderkey) total"))


@query("j9_dashboard", f"WITH {X.RESULTS}, {X.REPOS}, l AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, job_id DESC) = 1) SELECT r.repo_id, l.job_id IS NOT NULL AS has_analysis, l.job_id, l.quality_score FROM repositories r LEFT JOIN l USING (repo_id)")
def j9(spark, d):
    return J.dashboard(X.repositories(spark, d), X.results(spark, d))


@query("j10_complete_jobs", f"WITH {X.JOBS} SELECT job_id, repo_id, CASE WHEN event_id % 10 = 3 THEN 'done' ELSE status END AS status, CASE WHEN event_id % 10 = 3 THEN 100 ELSE progress END AS progress, CASE WHEN event_id % 10 <> 3 THEN error_message END AS error_message, CASE WHEN event_id % 10 = 3 THEN {DNOW} END AS completed_at FROM jobs")
def j10(spark, d):
    jobs = X.jobs(spark, d)
    return J.complete_jobs(jobs, jobs.where("event_id % 10 = 3"), now())


@query("j10_mark_analyzed", f"WITH {X.JOBS}, {X.REPOS} SELECT repo_id, CASE WHEN repo_id IN (SELECT repo_id FROM jobs WHERE event_id % 10 = 3) THEN {DNOW} ELSE TIMESTAMP '2020-01-01' END AS last_analyzed_at FROM repositories")
def j10_repositories(spark, d):
    jobs = X.jobs(spark, d)
    repos = X.repositories(spark, d).select("repo_id", F.expr("timestamp'2020-01-01 00:00:00'").alias("last_analyzed_at"))
    return J.mark_analyzed(repos, jobs, jobs.where("event_id % 10 = 3"), now())


@query("j12_valid_tokens", f"""WITH {X.TOKENS}, asked AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS share_id, CASE WHEN o_orderkey % 10 = 0 THEN 'other' ELSE o_custkey::VARCHAR END AS repo_id FROM orders UNION ALL SELECT -1, 'none', 'other')
SELECT share_id, a.repo_id, CASE WHEN t.repo_id IS NULL OR t.repo_id <> a.repo_id THEN 'invalid' WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at <= TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'valid' END AS state FROM asked a LEFT JOIN tokens t USING (share_id)""")
def j12(spark, d):
    asked = X.table(spark, d, "orders").selectExpr("cast(o_orderkey as string) share_id", "if(o_orderkey % 10 = 0, 'other', cast(o_custkey as string)) repo_id").union(spark.sql("select 'none', 'other'"))
    return J.valid_tokens(X.tokens_table(spark, d), asked, F.expr("timestamp'1996-01-01'"))


# --- embedding ---------------------------------------------------------------------------------------------------------


@query("v1_embed")
def v1(spark, d):
    return V.embed_hashed(X.whole(spark, d), 64).select("repo_id", "chunk_id", "embedding")


def cache(spark, d):
    return X.whole(spark, d).where("cast(chunk_id as long) % 3 != 0").select(F.lit("m").alias("model"), P.content_hash(F.col("content")).alias("content_hash"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.expr(f"{X.NOW} - make_interval(0, 0, 0, cast(cast(chunk_id as long) % 10 as int))").alias("stored_at"))


@query("v2_embed_with_cache", f"""WITH {X.WHOLE}, h AS (SELECT chunk_id, sha256(content) AS content_hash FROM whole), c AS (SELECT DISTINCT sha256(content) AS content_hash FROM whole WHERE chunk_id::BIGINT % 3 <> 0 AND chunk_id::BIGINT % 10 <= 7)
SELECT chunk_id, content_hash, c.content_hash IS NOT NULL AS hit, CASE WHEN c.content_hash IS NULL THEN 64 ELSE 1 END AS dim FROM h LEFT JOIN c USING (content_hash)""")
def v2(spark, d):
    """Cached vectors have one number, those made now 64."""
    found, _ = V.embed_with_cache(X.whole(spark, d), cache(spark, d), "m", now(), lambda texts: V.embed_hashed(texts, 64))
    return found.select("chunk_id", "content_hash", (F.size("embedding") == 1).alias("hit"), F.size("embedding").alias("dim"))


@query("v3_check_vectors", f"WITH {X.WHOLE}, {X.VECTORS} SELECT w.chunk_id, CASE WHEN v.chunk_id IS NULL THEN 'MISSING' ELSE 'EMBED_VECTOR_MISMATCH' END AS error_code FROM whole w LEFT JOIN vectors v USING (chunk_id) WHERE v.chunk_id IS NULL OR w.chunk_id::BIGINT % 4 = 0")
def v3(spark, d):
    vectors = X.vectors(spark, d).withColumn("embedding", F.when(F.expr("cast(chunk_id as long) % 4 = 0"), F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    return V.check_vectors(X.whole(spark, d), vectors, 64)


# --- evaluation --------------------------------------------------------------------------------------------------------

_BINS = ", ".join(f"count(*) FILTER (greatest(value, 0) <= {b}) AS le_{b}" for b in E.BUCKETS)


@query("e1_duration_histogram", f"SELECT event_type, {_BINS}, count(value) AS n, round_even(sum(greatest(value, 0)), 4) AS total FROM events GROUP BY event_type")
def e1(spark, d):
    return E.duration_histogram(X.table(spark, d, "events"), ["event_type"], "value")


@query("e2_label_counters", "SELECT lower(l_returnflag) AS l_returnflag, CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE lower(l_linestatus) END AS l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def e2(spark, d):
    return E.label_counters(X.table(spark, d, "lineitem").withColumn("l_linestatus", F.expr("if(l_linenumber = 1, ' ', l_linestatus)")), ["l_returnflag", "l_linestatus"])


@query("e3_nearest_rank_percentile", "SELECT event_type, list_sort(list(value))[greatest(1, ceil(count(*) * 5e-1)::INT)] AS p50, list_sort(list(value))[greatest(1, ceil(count(*) * 95e-2)::INT)] AS p95 FROM events GROUP BY event_type")
def e3(spark, d):
    ranks = E.nearest_rank(X.table(spark, d, "events"), "value", (50, 95), ("event_type",))
    return ranks.groupBy("event_type").agg(*[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(f"p{p}") for p in (50, 95)])


@query("e4_sla_report", f"""WITH {X.JOBS}, a AS (SELECT list_sort(list(value * 5) FILTER (status = 'done')) AS s, list_sort(list(value * 40) FILTER (event_id % 3 <> 0)) AS t FROM jobs),
p AS (SELECT s[greatest(1, ceil(len(s) * 5e-1)::INT)] AS analysis_p50, s[greatest(1, ceil(len(s) * 95e-2)::INT)] AS analysis_p95, t[greatest(1, ceil(len(t) * 5e-1)::INT)] AS token_p50, t[greatest(1, ceil(len(t) * 95e-2)::INT)] AS token_p95 FROM a) SELECT *, analysis_p95 < 180 AS analysis_ok, token_p95 < 1000 AS token_ok FROM p""")
def e4(spark, d):
    return E.sla_report(X.jobs(spark, d).selectExpr("status", "value * 5 as seconds", "if(event_id % 3 != 0, value * 40, null) token_ms"))


@query("e5_latency_ok_avg", f"WITH {X.SCORES} SELECT run_type, coalesce(round_even(avg(latency_ms) FILTER (status = 'ok'), 3), 0) AS latency_ms, count(*) FILTER (status = 'ok') AS n FROM scores GROUP BY run_type")
def e5(spark, d):
    return E.latency_ok_avg(X.scores(spark, d))


_CARD = f"{X.SCORES}, r AS (SELECT * FROM scores WHERE question_id % 5 <> 0), card AS (SELECT run_type, round_even(avg(s.relevance), 3) AS relevance, round_even(avg(s.correctness), 3) AS correctness, coalesce(round_even(count(*) FILTER (NOT r.no_citation AND s.correctness >= 2)::DOUBLE / nullif(count(*) FILTER (NOT r.no_citation), 0), 3), 0) AS \"precision\", round_even(count(*) FILTER (NOT r.no_citation AND s.correctness >= 2)::DOUBLE / count(*), 3) AS recall FROM scores s LEFT JOIN r USING (run_type, repo_key, question_id) GROUP BY run_type)"


@query("e6_scorecard_metrics", f"WITH {_CARD} SELECT * FROM card")
def e6(spark, d):
    s = X.scores(spark, d)
    return E.scorecard_metrics(s.drop("no_citation", "result_no"), s.where("question_id % 5 != 0"))


@query("e7_run_delta", f"""WITH {_CARD}, u AS (UNPIVOT card ON relevance, correctness, "precision", recall INTO NAME metric VALUE v), p AS (SELECT metric, max(v) FILTER (run_type = 'baseline') AS baseline, max(v) FILTER (run_type = 'candidate') AS candidate FROM u GROUP BY metric) SELECT *, round_even(candidate - baseline, 3) AS delta FROM p""")
def e7(spark, d):
    return E.run_delta(e6(spark, d))


_SECTIONED = "- **Purpose**: a\n- Core modules: b\n* Runtime flow : c\n- output formats: d\n - Primary languages: e\n"


def answers(spark, d):
    """All texts of assistants, those of the first turn below a summary's sections; and once more those of turns 3 and 5, blank and short."""
    own = X.table(spark, d, "conversations").where("role = 'assistant'")
    whole = own.withColumn("answer", F.expr(f"if(turn = 1, concat('{_SECTIONED}', if(conv_id % 5 = 0, 'Representative paths include: x', ''), text), text)")).withColumn("more", F.lit(0))
    odd = own.where("turn in (3, 5)").withColumn("answer", F.expr("if(turn = 3, ' ', left(text, 39))")).withColumn("more", F.lit(500))
    return whole.unionByName(odd).select(F.expr("conv_id * 1000 + turn + more").alias("answer_id"), "answer", F.expr("if(conv_id % 2 = 0, 'Summary', 'other')").alias("intent"), F.expr("cast(conv_id % 3 as int)").alias("citation_count"), F.expr("if(turn = 5, 'error', 'ok')").alias("status"), F.length("text").cast("double").alias("latency_ms"))


_QUALITY = rf"""conv AS (SELECT *, 0 AS more, CASE WHEN turn = 1 THEN '{_SECTIONED}' || CASE WHEN conv_id % 5 = 0 THEN 'Representative paths include: x' ELSE '' END || text ELSE text END AS raw FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT *, 500, CASE WHEN turn = 3 THEN ' ' ELSE left(text, 39) END FROM conversations WHERE role = 'assistant' AND turn IN (3, 5)),
ans AS (SELECT conv_id * 1000 + turn + more AS answer_id, raw, conv_id % 2 = 0 AS summary, conv_id % 3 AS cites, CASE WHEN turn = 5 THEN 'error' ELSE 'ok' END AS status, length(text)::DOUBLE AS latency_ms FROM conv),
q0 AS (SELECT *, regexp_replace(regexp_replace(raw, '^{P.SPACES}', ''), '{P.SPACES}$', '') AS answer FROM ans),
q1 AS (SELECT *, answer = '' AS blank, cites <= 0 AS bare, len(regexp_extract_all(answer, '(?m)^\s*[-*] [^\S\r\n]*\S')) >= 4{"".join(f" AND regexp_matches(answer, '(?im)^{chr(92)}s*[-*]{chr(92)}s*(?:{x}|{chr(92)}*{chr(92)}*{x}{chr(92)}*{chr(92)}*){chr(92)}s*:')" for x in E.SECTIONS)} AS shaped, regexp_matches(answer, '(?i)parse/index stage identified|representative paths include') AS noisy, length(answer) < 40 AS short FROM q0),
q2 AS (SELECT *, CASE WHEN blank THEN 0 ELSE 1 END + CASE WHEN bare THEN 0 ELSE 1 END + CASE WHEN summary THEN CASE WHEN shaped THEN 2 ELSE 0 END + CASE WHEN noisy THEN 0 ELSE 1 END ELSE CASE WHEN short THEN 0 ELSE 1 END END AS score,
  concat_ws(',', CASE WHEN blank THEN 'empty_answer' END, CASE WHEN bare THEN 'missing_citations' END, CASE WHEN summary AND NOT shaped THEN 'summary_structure_incomplete' END, CASE WHEN summary AND noisy THEN 'summary_noise_phrase' END, CASE WHEN NOT summary AND short THEN 'answer_too_short' END) AS flags FROM q1),
quality AS (SELECT *, score >= 3 AND flags = '' AS passed FROM q2)"""


@query("e8_chat_quality", f"WITH {_QUALITY} SELECT answer_id, score, flags, passed FROM quality")
def e8(spark, d):
    return E.chat_quality(answers(spark, d))


@query("e9_chat_quality_rollup", f"WITH {_QUALITY} SELECT count(*) AS rows, round_even(100.0 * count(*) FILTER (status = 'ok' AND passed) / count(*) FILTER (status = 'ok')::DOUBLE, 2) AS pass_rate, round_even(100.0 * count(*) FILTER (status = 'ok' AND cites > 0) / count(*) FILTER (status = 'ok')::DOUBLE, 2) AS coverage, round_even(avg(latency_ms) FILTER (status = 'ok'), 2) AS latency_ms, count(*) FILTER (status <> 'ok' OR NOT passed) AS failed FROM quality")
def e9(spark, d):
    a = answers(spark, d)
    return E.chat_quality_rollup(a.join(E.chat_quality(a).select("answer_id", "passed"), "answer_id"))


@query("e10_rubric_gate", f"WITH {X.SCORES}, t AS (SELECT run_type, CASE WHEN status = 'ok' THEN relevance + correctness + coverage + clarity ELSE 0 END AS total FROM scores), g AS (SELECT run_type, round_even(avg(total), 3) AS mean, min(total)::BIGINT AS least, count(*) FILTER (total >= 7) AS rows_passed, count(*) AS rows FROM t GROUP BY run_type) SELECT *, mean >= 7.5 AND least >= 5 AS passed FROM g")
def e10(spark, d):
    return E.rubric_gate(X.scores(spark, d))


@query("e11_recall_at_k", f"WITH {_RANKED}, q AS (SELECT query_id, chunk_id, rank FROM ranked), rel AS (SELECT query_id, w.chunk_id FROM questions JOIN whole w USING (repo_id) WHERE contains(lower(w.content), lower(questions.q))), h AS (SELECT DISTINCT q.query_id FROM q JOIN rel USING (query_id, chunk_id) WHERE rank <= 5), a AS (SELECT DISTINCT query_id FROM rel) SELECT count(*) AS questions, round_even(avg(CASE WHEN h.query_id IS NULL THEN 0 ELSE 1 END), 4) AS recall FROM a LEFT JOIN h USING (query_id)")
def e11(spark, d):
    """Relevant to a question is what holds it word for word."""
    asked = X.questions(spark, d).select("query_id", "repo_id", "q")
    relevant = X.whole(spark, d).join(asked, "repo_id").where(F.contains(F.lower("content"), F.lower("q"))).select("query_id", "chunk_id")
    return E.recall_at_k(ranked(spark, d), relevant)


@query("e12_client_event_rollup", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS event, '/r' || user_id % 9 AS route, count(*) AS n, round_even(avg(CASE WHEN event_id % 3 <> 0 THEN (event_id % 500)::DOUBLE END), 4) AS mean_ms FROM events WHERE event_id % 11 <> 0 GROUP BY ALL")
def e12(spark, d):
    return E.client_event_rollup(P.client_events(client_payloads(spark, d)))
