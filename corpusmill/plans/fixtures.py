"""How the driver's tables stand in for the operators' inputs, in Spark and, as common table expressions, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import split_lines
from corpusmill.operators.chunking import line_window_chunks

SIZE, OVERLAP = 8, 2
NOW = "timestamp'2024-01-02 00:00:00'"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    path = F.expr("case when doc_id % 97 = 0 then 'README.md' else concat(element_at(array('src', 'app', 'pkg/tests', 'docs'), cast(doc_id % 4 as int) + 1), '/f', doc_id, '.', element_at(array('py', 'ts', 'go', 'md', 'js'), cast(doc_id % 5 as int) + 1)) end")
    return table(spark, d, "documents").select(F.col("source").alias("repo_id"), path.alias("file_path"), F.col("text").alias("content"), "doc_id")


FILES = """files AS (SELECT source AS repo_id, CASE WHEN doc_id % 97 = 0 THEN 'README.md' ELSE ['src', 'app', 'pkg/tests', 'docs'][doc_id % 4 + 1] || '/f' || doc_id || '.' || ['py', 'ts', 'go', 'md', 'js'][doc_id % 5 + 1] END AS file_path,
  text AS content, doc_id FROM documents)"""
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LINES = FILES + rf""", raw AS (SELECT *, regexp_split_to_array(content, '{_BREAK}') AS r FROM files),
lined AS (SELECT repo_id, file_path, doc_id, CASE WHEN r[-1] = '' THEN r[:len(r) - 1] ELSE r END AS lines FROM raw)"""


def chunks(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return line_window_chunks(files(spark, d), SIZE, OVERLAP, keep)


CHUNKS = LINES + """, cut AS (SELECT *, len(lines) AS n, unnest(range(CASE WHEN len(lines) <= 8 THEN 1 ELSE 1 + ceil((len(lines) - 8) / 6.0)::INT END)) AS i FROM lined WHERE len(lines) > 0),
chunks AS (SELECT repo_id, file_path, (i * 6 + 1)::INT AS start_line, least(i * 6 + 8, n)::INT AS end_line, array_to_string(lines[i * 6 + 1:least(i * 6 + 8, n)], chr(10)) AS content,
  CASE WHEN file_path = 'README.md' THEN 'md' ELSE regexp_extract(file_path, '[^.]+$') END AS language, sha256(repo_id || '|' || file_path || '|' || (i * 6 + 1) || '|' || least(i * 6 + 8, n)) AS chunk_id FROM cut)"""


def whole(spark: SparkSession, d: str) -> DataFrame:
    """One chunk for each document, so that vectors and texts share their ids."""
    return files(spark, d).select("repo_id", F.col("doc_id").cast("string").alias("chunk_id"), "file_path", F.lit(1).alias("start_line"), F.size(split_lines(F.col("content"))).alias("end_line"), "content", F.regexp_extract("file_path", "[^.]+$", 0).alias("language"))


WHOLE = LINES + ", whole AS (SELECT repo_id, doc_id::VARCHAR AS chunk_id, file_path, 1 AS start_line, len(lines)::INT AS end_line, content, regexp_extract(file_path, '[^.]+$') AS language FROM lined JOIN files USING (repo_id, file_path, doc_id))"


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Each sentence of each benchmark text, asked of the repository of the document of the text's number, with the vector of that number."""
    parts = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "[.]", -1)).alias("nth", "part"))
    text = F.array_join(F.regexp_extract_all("part", F.lit("[A-Za-z0-9]+"), 0), " ")
    asked = parts.select("item_id", (F.col("item_id") * 1000 + F.col("nth")).alias("query_id"), text.alias("q")).where("q != ''")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return asked.join(vectors, "item_id", "left").join(files(spark, d).select(F.col("doc_id").alias("item_id"), "repo_id"), "item_id").drop("item_id")


QUESTIONS = """sentences AS (SELECT item_id, regexp_split_to_array(text, '[.]') AS p FROM benchmark), sentence AS (SELECT item_id, unnest(p) AS x, unnest(range(len(p))) AS nth FROM sentences),
asked AS (SELECT item_id, item_id * 1000 + nth AS query_id, array_to_string(regexp_extract_all(x, '[A-Za-z0-9]+'), ' ') AS q FROM sentence),
questions AS (SELECT a.query_id, a.q, e.embedding, f.repo_id FROM asked a JOIN files f ON f.doc_id = a.item_id LEFT JOIN embeddings e ON e.vec_id = a.item_id WHERE a.q <> '')"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = files(spark, d).select("repo_id", "doc_id")
    return table(spark, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).select("repo_id", F.col("doc_id").cast("string").alias("chunk_id"), "embedding")


VECTORS = "vectors AS (SELECT repo_id, doc_id::VARCHAR AS chunk_id, embedding FROM embeddings JOIN files ON vec_id = doc_id)"


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """Python and TypeScript files under src: two import lines before each document's text. File f imports f div 2 and, by a hash of its text, any file up to f."""
    n = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr("doc_id div 4").alias("f"))
    top = F.expr("element_at(array('src0', 'src1', 'src2', 'src3'), cast(doc_id % 4 as int) + 1)")
    path = F.expr("concat('src/f', f, if(doc_id % 8 < 4, '.py', '.ts'))")
    one, two = F.expr("cast(f div 2 as string)"), F.expr("cast(cast(conv(substring(md5(text), 1, 6), 16, 10) as long) % (f + 1) as string)")
    text = F.when(F.expr("doc_id % 8 < 4"), F.concat(F.lit("import src.f"), one, F.lit(" as x, os\nfrom src.f"), two, F.lit(" import y\n"), "text")).otherwise(F.concat(F.lit("import {\n  a,\n} from './f"), one, F.lit("'\nexport const p = './none'\nconst b = require('../src/f"), two, F.lit("')\n"), "text"))
    return n.select(top.alias("repo_id"), path.alias("file_path"), F.lit(1).alias("start_line"), text.alias("content"))


CODE = """code AS (SELECT ['src0', 'src1', 'src2', 'src3'][doc_id % 4 + 1] AS repo_id, doc_id // 4 AS f, doc_id % 8 < 4 AS py, 'src/f' || (doc_id // 4) || CASE WHEN doc_id % 8 < 4 THEN '.py' ELSE '.ts' END AS file_path, coalesce(text, '') AS text FROM documents),
refs AS (SELECT *, f // 2 AS g FROM code UNION ALL SELECT *, ('0x' || md5(text)[1:6])::BIGINT % (f + 1) FROM code),
edges AS (SELECT DISTINCT r.repo_id, r.file_path AS source, t.file_path AS target, CASE WHEN r.py THEN 'python' ELSE 'javascript' END AS kind FROM refs r JOIN code t ON t.repo_id = r.repo_id AND t.py = r.py AND t.f = r.g WHERE t.file_path <> r.file_path)"""


def diffs(spark: SparkSession, d: str, repo: str = "source", path: str = "concat('auth/f', doc_id, '.py')", newest: str = "doc_id") -> DataFrame:
    """A diff for each document: its lines added or removed by parity, in two files; every third with the line breaks of another system."""
    docs = table(spark, d, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 2 == 0, "+").otherwise("-"), x))
    head = lambda name: F.concat(F.lit("diff --git a/"), F.expr(name), F.lit(" b/"), F.expr(name), F.lit("\n"))
    body = F.concat(head(path), F.when(F.expr("doc_id % 6 = 0"), "new file mode 100644\n").otherwise(""), F.lit("@@ -1,2 +10,5 @@\n"), F.array_join(lines, "\n"), F.lit("\n"), head("concat('doc', doc_id, '.py')"), F.lit("@@ -3 +4 @@\n+one\n-two"))
    body = F.when(F.expr("doc_id % 3 = 0"), F.regexp_replace(body, "\n", "\r\n")).otherwise(body)
    return docs.select(F.expr(repo).alias("repo_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("head_sha"), body.alias("diff_text"), F.expr(f"timestamp_seconds(1700000000 + {newest})").alias("created_at"))


DIFFS = """dl AS (SELECT source AS repo_id, doc_id, sha256(doc_id::VARCHAR) AS head_sha, string_split(text, chr(10)) AS l FROM documents),
dp AS (SELECT repo_id, doc_id, head_sha, unnest(l) AS x, unnest(range(len(l))) AS i FROM dl),
da AS (SELECT repo_id, doc_id, head_sha, count(*) FILTER (i % 2 = 0 AND NOT starts_with(x, '++')) AS added, count(*) FILTER (i % 2 = 1 AND NOT starts_with(x, '--')) AS removed,
  list(x ORDER BY i) FILTER (i % 2 = 0 AND NOT starts_with(x, '++')) AS plus FROM dp GROUP BY ALL),
df AS (SELECT repo_id, doc_id, head_sha, 1 AS file_no, 'auth/f' || doc_id || '.py' AS path, CASE WHEN doc_id % 6 = 0 THEN 'added' ELSE 'modified' END AS status, added, removed, 10 AS hs, 14 AS he, plus[1:200] AS plus FROM da
  UNION ALL SELECT repo_id, doc_id, head_sha, 2, 'doc' || doc_id || '.py', 'modified', 1, 1, 4, 4, ['one'] FROM dl)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.expr("element_at(array('queued', 'parsing', 'embedding', 'analyzing', 'done', 'failed'), cast(event_id % 6 as int) + 1)")
    message = F.expr("case when event_id % 6 = 5 then if(event_id % 4 = 1, 'CLONE_TIMEOUT: no answer: twice', 'plain message') end")
    return e.select(F.col("event_id").cast("string").alias("job_id"), "event_id", F.col("user_id").cast("string").alias("repo_id"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("commit_sha"), F.concat(F.lit("k"), (F.col("event_id") % 5).cast("string")).alias("idempotency_key"), status.alias("status"), F.expr("cast(event_id % 100 as int)").alias("progress"), message.alias("error_message"), F.expr("event_id % 5").alias("retry_count"), F.expr("if(event_id % 2 = 0, ts + interval 1 hour, null)").alias("next_retry_at"), F.col("ts").alias("created_at"), "ts", "value")


JOBS = """jobs AS (SELECT event_id::VARCHAR AS job_id, event_id, user_id::VARCHAR AS repo_id, 'c' || event_id % 3 AS commit_sha, 'k' || event_id % 5 AS idempotency_key, ['queued', 'parsing', 'embedding', 'analyzing', 'done', 'failed'][event_id % 6 + 1] AS status,
  (event_id % 100)::INT AS progress, CASE WHEN event_id % 6 = 5 THEN CASE WHEN event_id % 4 = 1 THEN 'CLONE_TIMEOUT: no answer: twice' ELSE 'plain message' END END AS error_message, event_id % 5 AS retry_count,
  CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 1 HOUR END AS next_retry_at, ts AS created_at, ts, value FROM events)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    """Analysis results: one for each done or failed job, as far as the repositories have them."""
    return jobs(spark, d).where("status in ('done', 'failed')").select("repo_id", "job_id", F.expr("event_id % 101").alias("quality_score"), "created_at", F.expr("if(event_id % 3 = 0, map('py', 1.5D), null)").alias("languages"))


RESULTS = JOBS + ", results AS (SELECT repo_id, job_id, event_id % 101 AS quality_score, created_at, CASE WHEN event_id % 3 = 0 THEN '{\"py\":1.5}' ELSE '{}' END AS languages FROM jobs WHERE status IN ('done', 'failed'))"


def repositories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("repo_id"), F.concat(F.lit("o/"), F.col("c_custkey").cast("string")).alias("full_name"))


REPOS = "repositories AS (SELECT c_custkey::VARCHAR AS repo_id, 'o/' || c_custkey AS full_name FROM customer)"


def code_repositories(spark: SparkSession, d: str) -> DataFrame:
    """The repositories of the documents, and one without any."""
    repos = table(spark, d, "documents").select(F.col("source").alias("repo_id")).union(spark.sql("select 'empty'")).distinct()
    return repos.select("repo_id", F.concat(F.lit("o/"), F.col("repo_id")).alias("full_name"), F.lit("main").alias("default_branch"), F.lit("Python").alias("language"))


CODE_REPOS = "code_repos AS (SELECT repo_id, 'o/' || repo_id AS full_name, 'main' AS default_branch FROM (SELECT DISTINCT source AS repo_id FROM documents UNION SELECT 'empty'))"


def tokens_table(spark: SparkSession, d: str) -> DataFrame:
    """Share tokens: one for each order, some revoked, some expired."""
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("share_id"), F.col("o_custkey").cast("string").alias("repo_id"), F.col("o_orderdate").alias("expires_at"), F.expr("if(o_orderkey % 7 = 0, o_orderdate, null)").alias("revoked_at"))


TOKENS = "tokens AS (SELECT o_orderkey::VARCHAR AS share_id, o_custkey::VARCHAR AS repo_id, o_orderdate AS expires_at, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS revoked_at FROM orders)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Scorecards from labels: two runs by parity, repositories by source."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n")), "doc_id")
    run = F.when(F.col("doc_id") % 2 == 0, "baseline").otherwise("candidate")
    return l.select(run.alias("run_type"), F.col("source").alias("repo_key"), F.col("doc_id").alias("question_id"), (F.col("quality") * 2 + F.col("toxic")).alias("relevance"), (F.col("n") % 4).cast("int").alias("correctness"), (F.col("n") % 3).cast("int").alias("coverage"), (F.col("doc_id") % 3).cast("int").alias("clarity"), F.when(F.col("n") % 10 == 0, "error").otherwise("ok").alias("status"), (F.col("n") % 1000).cast("double").alias("latency_ms"), (F.col("n") % 5 == 0).alias("no_citation"), F.col("n").alias("result_no"))


SCORES = """scores AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS run_type, source AS repo_key, doc_id AS question_id, quality * 2 + toxic AS relevance, (length(text) % 4)::INT AS correctness, (length(text) % 3)::INT AS coverage,
  (doc_id % 3)::INT AS clarity, CASE WHEN length(text) % 10 = 0 THEN 'error' ELSE 'ok' END AS status, (length(text) % 1000)::DOUBLE AS latency_ms, length(text) % 5 = 0 AS no_citation, length(text) AS result_no FROM labels JOIN documents USING (doc_id))"""


def sessions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "conversations")
    own = c.select(F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user_id"), F.concat(F.lit("r"), (F.col("conv_id") % 3).cast("string")).alias("repo_id"), F.expr("timestamp_seconds(1700000000 + conv_id)").alias("created_at")).distinct()
    return own, c.select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content"))


SESSIONS = """sessions AS (SELECT DISTINCT conv_id::VARCHAR AS session_id, 'u' || conv_id % 7 AS user_id, 'r' || conv_id % 3 AS repo_id, make_timestamp((1700000000 + conv_id) * 1000000) AS created_at FROM conversations), messages AS (SELECT conv_id::VARCHAR AS session_id, turn, role, text AS content FROM conversations)"""
