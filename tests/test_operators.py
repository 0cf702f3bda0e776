"""The survey's operators: literal cases, every DuckDB twin on the smallest tables, and streams against their batch twins."""

import hashlib
import math
import os
import subprocess
import sys
import time
from datetime import datetime, timedelta
from decimal import ROUND_HALF_EVEN, Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as P
from corpusmill.operators import analysis, approximate, chunking, diff, embedding, evaluation, graph, grounding, jobs, retrieval
from corpusmill.plans.registry import ORACLE_SQL, QUERIES
from corpusmill.sources import snapshots, tables
from corpusmill.streaming import streams

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def spell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(spell, v)) + "]"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(spell(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(spell(dict(zip(names, row))[c]) for c in columns) for row in found.fetchall())


def test_imports_of_scripts(spark):
    text = "import {\n a,\n b\n} from './x'\nexport const p = './y'\nexport * from \"../z\"\nimport './w'\nconst q = require( './v' )"
    files = spark.createDataFrame([("r", "a.ts", text), ("r", "a.md", text)], "repo_id string, file_path string, content string")
    assert sorted(r.ref for r in graph.extract_imports(files).collect()) == ["../z", "./v", "./w", "./x"]
    assert {r.kind for r in graph.extract_imports(files).collect()} == {"javascript"}


def test_files_of_one_path_are_joined_by_row(spark, tmp_path):
    """Documents 0, 97 and 194 of a source are all its README.md; none of their chunks is in the order of its content."""
    rows = [(0, "s", "z"), (97, "s", "\n".join(["y"] * 9)), (194, "s", "x\n" * 9), (1, "s", "w")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    first = ["z", "\n".join(["y"] * 8), "\n".join(["x"] * 8), "\n".join(["y"] * 3), "\n".join(["x"] * 3)]
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(con.execute(ORACLE_SQL["g1_merge_file_text"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["g1_merge_file_text"](spark, str(tmp_path)).collect())
    assert got == want and ("s", "README.md", hashlib.sha256("\n".join(first).encode()).hexdigest()) in got


def test_blast_radius_is_logarithmic_in_depth(spark, monkeypatch):
    n = 5000
    chain = spark.range(n).select(F.lit("r").alias("repo_id"), F.concat(F.lit("f"), F.col("id") + 1).alias("source"), F.concat(F.lit("f"), "id").alias("target"))
    written = []
    real = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, label: written.append(label) or real(df, label))
    reach = graph.blast_radius(chain, spark.createDataFrame([("r", "f0")], "repo_id string, file_path string"))
    assert reach.count() == n and written.count("new") < 20
    # a wide star of importers, which hops must not square, kept apart by commit; a cycle; a changed file nobody imports
    star = [("r", f"s{i}", "hub") for i in range(300)] + [("r", "hub", f"t{i}") for i in range(300)] + [("r", "a", "b"), ("r", "b", "a")]
    edges = spark.createDataFrame(star, "repo_id string, source string, target string")
    asked = spark.createDataFrame([("r", "c1", "t7"), ("r", "c2", "a"), ("r", "c3", "s1")], "repo_id string, head_sha string, file_path string")
    found = {(r.head_sha, r.file_path) for r in graph.blast_radius(edges, asked).collect()}
    assert found == {("c1", "hub"), *(("c1", f"s{i}") for i in range(300)), ("c2", "b")}


def test_durable_tables_need_no_setting(tmp_path):
    """A session without any configuration writes its tables to a folder of its own, which is gone at exit."""
    code = (
        "import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "from corpusmill.plans.registry import QUERIES\n"
        "from corpusmill.sources import tables\n"
        "print('rows', QUERIES['g5_blast_radius'](spark, {d!r}).count(), tables.shared_folder(spark))\n"
    ).format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), d=DIR)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_CONF", "PYSPARK_SUBMIT"))} | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    said = next(x for x in done.stdout.splitlines() if x.startswith("rows"))
    assert int(said.split()[1]) > 0 and not os.path.exists(said.split()[2].removeprefix("file://")), done.stderr[-2000:]


def test_split_lines_like_python(spark):
    texts = ["", "a", "a\n", "\n", "a\r\nb\rc", "a\n\nb\x0b\x0c\x85c d", "\n\n"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.split_lines(F.col("t")).alias("x")).collect()]
    assert got == [t.splitlines() for t in texts]


def test_line_windows(spark):
    files = spark.createDataFrame([("r", "a.py", "\n".join(map(str, range(1, 11))))], "repo_id string, file_path string, content string")
    assert [(r.start_line, r.end_line) for r in chunking.line_window_chunks(files, 4, 1).orderBy("start_line").collect()] == [(1, 4), (4, 7), (7, 10)]
    with pytest.raises(ValueError, match="INVALID_CHUNK_CONFIG"):
        chunking.line_window_chunks(files, 10, 10)


def test_definition_split(spark):
    text = "import os\n\n\ndef alpha():\n    return 1\n\n\nclass Beta:\n    x = 1\n"
    got = chunking.definition_chunks(spark.createDataFrame([("r", "a.py", text)], "repo_id string, file_path string, content string")).orderBy("start_line").collect()
    assert [r.content.split("\n")[0] for r in got] == ["import os", "def alpha():", "class Beta:"]


def test_file_filter_and_tree(spark, tmp_path):
    paths = ["src/a.py", "src/b.txt", "node_modules/x.js", ".env", "Dockerfile"]
    got = tables.filter_source_files(spark.createDataFrame([(p,) for p in paths], "file_path string")).collect()
    assert {r.file_path for r in got} == {"src/a.py", "Dockerfile"}
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\xff\n")
    row = tables.read_source_tree(spark, str(tmp_path), "r").first()
    assert (row.file_path, row.content) == ("src/a.py", "x = 1\n")


def scanned(df):
    """Runs df; (files that its scan opened, partitions that it read them in)."""
    n = df.rdd.getNumPartitions()
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return leaves.apply(0).metrics().apply("numFiles").value(), n


def test_tree_opens_source_files_alone(spark, tmp_path):
    """3,000 files, a third of them source: no other is opened, and they are dealt over several tasks."""
    for folder, suffix in (("src/deep", "py"), ("node_modules/x", "js"), ("docs", "bin")):
        (tmp_path / "t" / folder).mkdir(parents=True)
        for i in range(1000):
            (tmp_path / "t" / folder / f"f {i}.{suffix}").write_text(f"x = {i}")
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        tree = tables.read_source_tree(spark, f"file://{tmp_path}/t", "r", only_source=True)
        assert tree.count() == 1000 and {r.file_path for r in tree.limit(3).collect()} <= {f"src/deep/f {i}.py" for i in range(1000)}
        files, parts = scanned(tree)
        assert files == 1000 and parts >= 8
        assert scanned(tables.read_source_tree(spark, f"{tmp_path}/t", "r"))[0] == 3000
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_summaries_of_a_stream(spark, tmp_path):
    """Histograms and sketches of a stream: those of all its samples; ranks of sketches within 1 % of exact ones."""
    rows = spark.range(30_000).selectExpr("concat('s', id % 3) series", "pow(hash(id) % 1000 / 100.0D, 2) * (id % 3 + 1) v", "cast(id % 5 as int) part").withColumn("v", F.when(F.expr("part = 4 and series = 's1'"), None).otherwise(F.col("v")))
    for i in range(3):
        rows.where(F.pmod("part", F.lit(3)) == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    histogram = evaluation.duration_histogram(rows, ["series"], "v")
    kinds = {"sketches": snapshots.StoredTable("series string, sketch binary", "series"), "histogram": snapshots.StoredTable(", ".join(f"{c} {k}" for c, k in histogram.dtypes), "series")}
    store = snapshots.SnapshotStore(str(tmp_path / "store"), kinds, 4)
    source = lambda: spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs_of = {"sketches": (lambda r: evaluation.percentile_sketches(r, "v", ["series"]), lambda a, b: evaluation.merge_sketches(a, b, ["series"])), "histogram": (lambda r: evaluation.duration_histogram(r, ["series"], "v"), lambda a, b: evaluation.merge_histograms(a, b, ["series"]))}
    for name, (summarise, merged) in jobs_of.items():
        streams.summary_stream(source(), store, name, summarise, merged, str(tmp_path / name)).awaitTermination(120)
    assert len(store.versions(spark)) == 6
    percents = (1.0, 25.0, 50.0, 95.0, 99.0)
    exact = sorted(map(spell, histogram.drop("total").collect()))
    assert sorted(map(spell, store.read(spark, "histogram").drop("total").collect())) == exact
    values = {s: np.sort([r.v for r in rows.where(f"series = '{s}' and v is not null").collect()]) for s in ("s0", "s1", "s2")}
    found = evaluation.sketched_percentiles(store.read(spark, "sketches"), percents, ["series"]).collect()
    assert len(found) == 15
    for r in found:
        own = values[r.series]
        low, high = np.searchsorted(own, r.value, "left") / len(own), np.searchsorted(own, r.value, "right") / len(own)
        assert r.n == len(own) and low - 0.01 <= r.percent / 100 <= high + 0.01
    near = {(r.series, r.percent): r.value for r in evaluation.nearest_rank(rows, "v", percents, ("series",)).collect()}
    assert all(abs(np.searchsorted(values[s], near[s, p]) / len(values[s]) - p / 100) < 0.01 for s, p in near)


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "repo_id string, n int")
    tables.replace_chunks(one, str(tmp_path / "c"))
    tables.replace_chunks(spark.createDataFrame([("a", 9)], "repo_id string, n int"), str(tmp_path / "c"))
    assert {(r.repo_id, r.n) for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {("a", 9), ("b", 2)}
    rows = spark.createDataFrame([("r", "k", "q", "ok", 1.5, 2)], tables.EVAL_SCHEMA)
    for name in ("x.csv", "x.json"):
        tables.write_eval(rows, str(tmp_path / name))
        assert tables.read_eval(spark, str(tmp_path / name)).collect() == rows.collect()


def test_capacity(spark):
    rows = spark.createDataFrame([("r",)] * 3 + [("s",)], "repo_id string")
    guard = tables.capacity_guard(rows, 2, "FILE_LIMIT_EXCEEDED")
    assert {r.repo_id: r.error_code for r in guard.collect()} == {"r": "FILE_LIMIT_EXCEEDED", "s": None}
    assert [r.repo_id for r in tables.within_capacity(rows, guard).collect()] == ["s"]


def test_graph_and_blast_radius(spark):
    files = [("app/main.py", "import app.utils\nfrom app.handlers import x\nfrom . import y"), ("app/utils.py", "import app.main"), ("app/handlers.py", "x = 1"), ("web/a.ts", "import x from './b'\nconst c = require('../lib')"), ("web/b/index.ts", ""), ("lib.js", "")]
    chunks = spark.createDataFrame([("r", p, 1, t or " ") for p, t in files], "repo_id string, file_path string, start_line int, content string")
    edges = graph.dependency_edges(chunks)
    assert {(r.source, r.target) for r in edges.collect()} == {("app/main.py", "app/utils.py"), ("app/main.py", "app/handlers.py"), ("app/utils.py", "app/main.py"), ("web/a.ts", "web/b/index.ts"), ("web/a.ts", "lib.js")}
    changed = spark.createDataFrame([("r", "app/handlers.py"), ("r", "app/main.py"), ("r", "gone.py")], "repo_id string, file_path string")
    assert [r.file_path for r in graph.blast_radius(edges, changed).collect()] == ["app/utils.py"]


DIFF = """junk
diff --git a/auth.py b/auth.py
--- a/auth.py
+++ b/auth.py
@@ -10,4 +10,5 @@
+token = jwt(password)
+x
-y
diff --git a/README.md b/README.md
new file mode 100644
+++ b/README.md
@@ -0,0 +1,2 @@
+a
+b
diff --git a/old.py b/old.py
deleted file mode 100644
--- a/old.py
+++ /dev/null
-a
-b"""


def test_diff(spark):
    files = diff.diff_files(spark.createDataFrame([("r", "h", DIFF)], "repo_id string, head_sha string, diff_text string")).orderBy("file_no").collect()
    assert [(f.path, f.status, f.added, f.removed) for f in files] == [("auth.py", "modified", 2, 1), ("README.md", "added", 2, 0), ("old.py", "deleted", 0, 2)]
    assert (files[0].hunks[0].start, files[0].hunks[0].end) == (10, 14)
    flags = diff.security_touches(spark.createDataFrame(files)).collect()
    assert [f.path for f in flags] == ["auth.py"] and {"token", "jwt", "password"} <= set(flags[0].categories)


def test_diff_of_another_system(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/y.py\n@@ -1 +1,2 @@\n+one\n+two\n-three\n"
    both = spark.createDataFrame([("r", "1", text), ("r", "2", text.replace("\n", "\r\n"))], "repo_id string, head_sha string, diff_text string")
    found = [tuple(r) for r in diff.diff_files(both).drop("head_sha").collect()]
    assert found[0] == found[1] and found[0][2] == "y.py" and found[0][-1] == ["one", "two"]


def test_security_patterns_occur_once_in_the_plan(spark):
    both = spark.createDataFrame([("r", "1", "diff --git a/x.py b/x.py\n+my token")], "repo_id string, head_sha string, diff_text string")
    touched = diff.security_touches(diff.diff_files(both))
    assert touched.first().categories == ["token"]
    plan = touched._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bcrypt|sha256") == 1
    assert all(any(stem in word for stem in diff.SECURITY_STEMS[name]) for name, words in {"auth": ("auth", "authenticat", "authoriz"), "env": (".env", "env[", "os.environ"), "api_key": ("apikey", "api-key"), "crypto": ("encrypt", "decrypt", "hash", "hmac", "bcrypt", "sha256"), "password": ("password", "passwd")}.items() for word in words)


def test_equal_scores_go_by_chunk(spark):
    known = spark.createDataFrame([(1, "r", c, "p", 1, 1, "py", 0.5, n, "x") for n, c in enumerate(("zz", "aa", "mm"), 1)], "query_id int, repo_id string, chunk_id string, file_path string, start_line int, end_line int, language string, score double, rank int, content string")
    asked = spark.createDataFrame([(1, "r", "x")], "query_id int, repo_id string, q string")
    assert [r.chunk_id for r in retrieval.rerank(known, asked).orderBy("rank").collect()] == ["aa", "mm", "zz"]


def test_lexical_and_fusion(spark):
    rows = [("c1", "src/payment/service.py", "payment service charges"), ("c2", "src/auth/jwt.py", "jwt token"), ("c3", "readme.md", "the payment is far away from any other word of the service")]
    chunks = spark.createDataFrame([("r", c, p, 1, 2, t, "py") for c, p, t in rows], "repo_id string, chunk_id string, file_path string, start_line int, end_line int, content string, language string")
    asked = spark.createDataFrame([(1, "r", "payment service")], "query_id int, repo_id string, q string")
    got = retrieval.lexical_search(retrieval.build_lexical_index(chunks), chunks, asked).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c1", "c3"] and got[0].score > got[1].score > 0
    known = got and spark.createDataFrame([(1, "r", "c1", "a", 1, 1, "py", 0.9, 1, "x"), (1, "r", "c2", "b", 1, 1, "py", 0.2, 2, "y")], "query_id int, repo_id string, chunk_id string, file_path string, start_line int, end_line int, language string, score double, rank int, content string")
    better = retrieval.rerank(known, asked, scorer=lambda q, t: F.when(t.endswith("\ny"), 0.99).otherwise(0.1)).orderBy("rank").collect()
    assert [r.chunk_id for r in better] == ["c2", "c1"]
    failed = retrieval.rerank(known, asked, scorer=lambda q, t: F.when(t.endswith("\nx"), 0.1)).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in failed] == [("c1", 0.9), ("c2", 0.2)]


def searched(spark, vectors, asked, dim, **more):
    """(recall@10 against the exact search, share of all pairs that were scored, probes)."""
    probes = approximate.fit_probes(vectors, asked, dim, **more)
    index = approximate.build_vector_index(vectors, dim)
    found = approximate.approximate_search(vectors, index, asked, dim, probes, 10)
    met = approximate.probe(asked, dim, probes).join(index, ["repo_id", "table_no", "code"]).select("query_id", "chunk_id").distinct().count()
    every = asked.select("repo_id").join(vectors.select("repo_id"), "repo_id").count()
    return approximate.recall_of(found, retrieval.dense_search(vectors, asked, 10)), met / every, probes


def test_approximate_search_of_all_vectors(spark):
    """The given vectors have no near neighbours, so most buckets must be looked into; recall holds all the same."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumn("repo_id", F.lit("r"))
    dim = e.select(F.size("embedding")).first()[0]
    vectors, asked = e.select("repo_id", F.col("vec_id").cast("string").alias("chunk_id"), "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "repo_id", "embedding")
    recall, share, probes = searched(spark, vectors, asked, dim)
    assert recall >= 0.9 and share < 1 and probes <= 256
    print("recall", recall, "share", share, "probes", probes)
    assert approximate.build_vector_index(vectors, dim).count() == approximate.TABLES * vectors.count()


def test_approximate_search_of_near_vectors(spark):
    """Vectors around 200 centres, of two repositories: few buckets suffice, though the sample is smaller than the questions."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((200, 32))
    rows = [(f"r{i % 2}", str(i), [float(v) for v in centres[i % 200] + 0.15 * rng.standard_normal(32)]) for i in range(4000)]
    vectors = spark.createDataFrame(rows, "repo_id string, chunk_id string, embedding array<float>")
    asked = vectors.where("cast(chunk_id as int) % 20 = 0").select(F.col("chunk_id").cast("long").alias("query_id"), "repo_id", "embedding")
    recall, share, probes = searched(spark, vectors, asked, 32, most=50)
    print("recall", recall, "share", share, "probes", probes)
    assert recall >= 0.9 and share < 0.2
    odd = vectors.union(spark.createDataFrame([("r0", "short", [1.0]), ("r0", "none", None), ("r0", None, [0.0] * 32), ("r0", "zero", [0.0] * 32)], vectors.schema))
    index = approximate.build_vector_index(odd, 32)
    assert {r.chunk_id for r in index.where("chunk_id in ('short', 'none', 'zero') or chunk_id is null").collect()} == {"zero"}
    assert approximate.fit_probes(vectors.limit(0), asked.limit(0), 32) == 1 and approximate.approximate_search(odd, index, asked.limit(0), 32, 2).count() == 0


def test_dense_search_in_blocks(spark, monkeypatch):
    """Blocks of a few rows, equal vectors, and rows without a cosine: as all pairs scored one by one. Zero vectors have NaN, as in SQL."""
    rng, nan = np.random.default_rng(2), float("nan")
    rows = [("r", f"c{i}", [float(v) for v in np.round(rng.standard_normal(4), 1)]) for i in range(150)] + [("r", f"same{i}", [1.0, 2.0, 0.5, -1.0]) for i in range(150)] + [("s", f"d{i}", [-1.0, 0.0, 0.0, 0.0]) for i in range(3)]
    rows += [("r", "zero", [0.0] * 4), ("s", "empty", []), ("s", "short", [1.0]), ("s", "long", [1.0] * 5), ("s", "hole", [1.0, None, 1.0, 1.0]), ("s", "none", None), ("s", "nan", [nan, 1.0, 1.0, 1.0]), ("r", None, [1.0] * 4), (None, "lost", [1.0] * 4), ("t", "alone", [1.0] * 4)]
    asked = [(n, r, v) for n, (r, _, v) in enumerate(rows) if n % 4 == 0 or n > 299] + [(9000, "r", [1.0]), (9002, "s", []), (9001, "nowhere", [1.0] * 4), (None, "s", [1.0, 2.0, 3.0, 4.0])]

    def cosine(a, b):
        if b is None or len(a) != len(b) or None in a + b:
            return None

        def over(x, y):
            total = 0.0  # in this order: sum() adds up more exactly
            for p, q in zip(x, y):
                total += p * q
            return total

        size = math.sqrt(over(a, a)) * math.sqrt(over(b, b))
        return float(Decimal(repr(over(a, b) / size)).quantize(Decimal("0.0001"), ROUND_HALF_EVEN)) if size > 0 else nan

    last = lambda x: (x[0] is None, -math.inf if x[0] is None or x[0] != x[0] else -x[0], x[1])
    want = []
    for q, r, v in asked:
        found = [(cosine(v, w), c) for s, c, w in rows if r and s == r and c and v is not None]
        first = sorted(found, key=lambda x: (x[0] is None or x[0] == x[0], *last(x)))[:5]
        want += [(q, r, c, score, n) for n, (score, c) in enumerate(first, 1)]
    vectors, questions = spark.createDataFrame(rows, "repo_id string, chunk_id string, embedding array<double>"), spark.createDataFrame(asked, "query_id long, repo_id string, embedding array<double>")
    for cells in (1 << 20, 256):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        got = [tuple(r) for r in retrieval.dense_search(vectors, questions, 5).select("query_id", "repo_id", "chunk_id", "score", "rank").collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_dense_search_of_many_pairs(spark):
    """20,000,000 pairs of one repository, which took minutes when each was a row."""
    rng = np.random.default_rng(3)
    numbers = rng.standard_normal((20_000, 64)).astype(np.float32)
    vectors = spark.createDataFrame([("r", str(i), v.tolist()) for i, v in enumerate(numbers)], "repo_id string, chunk_id string, embedding array<float>")
    asked = vectors.where("cast(chunk_id as int) % 20 = 0").select(F.col("chunk_id").cast("long").alias("query_id"), "repo_id", "embedding")
    began = time.time()
    found = retrieval.dense_search(vectors, asked, 5).collect()
    assert time.time() - began < 45 and len(found) == 5000
    unit = numbers.astype(float) / np.linalg.norm(numbers.astype(float), axis=1, keepdims=True)
    best = -np.sort(-(unit[::20] @ unit.T), axis=1)[:, :5]
    assert all(abs(r.score - best[r.query_id // 20, r["rank"] - 1]) < 6e-5 for r in found)


def test_stored_index_opens_the_buckets_asked_for(spark, tmp_path):
    """R1 stored, R2 over it: as over an index built anew, from the folders of the questions' terms alone."""
    chunks = spark.createDataFrame([("r", f"c{i}", f"f{i}.py", f"common w{i % 50} x{i % 7} common", 1, 9, "py") for i in range(200)], "repo_id string, chunk_id string, file_path string, content string, start_line int, end_line int, language string")
    asked = spark.createDataFrame([(1, "r", "common w3"), (2, "r", "w3 x3 nowhere"), (3, "r", "x1 common"), (4, "other", "common")], "query_id int, repo_id string, q string")
    whole = retrieval.build_lexical_index(chunks)
    retrieval.save_lexical_index(whole, str(tmp_path / "index"), 16)
    read = retrieval.stored_lexical_index(spark, str(tmp_path / "index"), asked, 16)
    assert len({f.rsplit("/", 2)[1] for f in read._jdf.inputFiles()}) > 0
    opened = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in opened
    want = sorted(map(tuple, retrieval.lexical_search(whole, chunks, asked).collect()))
    assert want and {r[2] for r in want} >= {1, 3} and sorted(map(tuple, retrieval.lexical_search(read, chunks, asked).collect())) == want
    few = retrieval.index_of_terms(chunks, asked)
    assert sorted(map(tuple, retrieval.lexical_search(few, chunks, asked).collect())) == want and {r.term for r in few.collect()} == {"common", "w3", "x3", "x1"}
    retrieval.MAX_BROADCAST_TERMS, most = 0, retrieval.MAX_BROADCAST_TERMS
    try:
        assert sorted(map(tuple, retrieval.index_of_terms(chunks, asked).collect())) == sorted(map(tuple, few.collect()))
    finally:
        retrieval.MAX_BROADCAST_TERMS = most


def largest_share(df):
    """The rows of the largest partition that df comes in, over those of the mean one."""
    n = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) * 8 / sum(n)


def test_hot_files_and_terms_are_no_task_of_their_own(spark):
    """A file that 20,000 others import, and a term that all chunks hold."""
    n = 20_000
    imports = spark.range(n).selectExpr("'r' repo_id", "concat('a/m', id, '.py') file_path", "if(id % 10 = 0, concat('b.m', id), 'core') ref", "'python' kind").repartition(8)
    files = spark.range(n).selectExpr("'r' repo_id", "concat('b/m', id, '.py') file_path").union(spark.sql("select 'r', 'core.py'"))
    found = graph.resolve_imports(imports, files)
    assert found.count() == n and found.where("target = 'core.py'").count() == n * 9 // 10
    joined = tables.join_few(tables.durable(imports.withColumn("target", F.col("ref")), "hot"), spark.createDataFrame([("r", "core", 1)], "repo_id string, target string, x int"), ["repo_id", "target"])
    assert joined.count() == n * 9 // 10 and largest_share(joined) < 3
    index = spark.range(n).selectExpr("'r' repo_id", "explode(array('all', concat('w', id % 2000))) term", "concat('c', id) chunk_id", "array(1) positions")
    chunks = spark.range(n).selectExpr("'r' repo_id", "concat('c', id) chunk_id", "'f' file_path", "1 start_line", "2 end_line", "'py' language")
    asked = spark.range(200).selectExpr("id query_id", "'r' repo_id", "concat('all w', id) q")
    hits = retrieval.lexical_search(index, chunks, asked)
    assert hits.count() == 2000


def test_citations(spark):
    results = spark.createDataFrame([(1, "r", "c", "src/auth/jwt.py", 10, 30, 0.5, 1)], "query_id int, repo_id string, chunk_id string, file_path string, start_line int, end_line int, score double, rank int")
    assert grounding.format_citations(results).first().anchor == "src/auth/jwt.py#L10-L30"


def test_scores(spark):
    chunk = lambda p, a, z, t: ("r", p, a, z, t, "py", f"{p}{a}")
    rows = [chunk("a.py", 1 + 60 * i, 60 + 60 * i, "TODO " * 5) for i in range(100)] + [chunk("README.md", 1, 1, "x")]
    chunks = spark.createDataFrame(rows, "repo_id string, file_path string, start_line int, end_line int, content string, language string, chunk_id string")
    assert analysis.quality_score(chunks).first().quality_score == 25


def test_failures(spark):
    now = F.expr("timestamp'2024-01-01 00:00:00'")
    rows = [("a", "r", "embedding", "EMBED_UPSERT_FAILED", "m", 0), ("b", "r", "parsing", "CLONE_TIMEOUT", "late", 3)]
    failed = spark.createDataFrame(rows, "job_id string, repo_id string, stage string, error_code string, message string, retry_count int")
    got = {r.job_id: r for r in jobs.route_failures(failed, now, 3, 10).collect()}
    assert got["a"].retry_count == 1 and got["a"].next_retry_at == datetime(2024, 1, 1, 0, 0, 10) and not got["a"].dead_letter and got["a"].progress is None
    assert got["b"].status == "failed" and got["b"].dead_letter and got["b"].progress == 100 and got["b"].error_message == "CLONE_TIMEOUT: late"
    assert [tuple(r) for r in jobs.dead_letters(failed, 3).collect()] == [("b", "r", "parsing", "CLONE_TIMEOUT", "late", 3)]


def test_tokens_and_expiry(spark):
    now = F.expr("timestamp'2024-01-01 00:00:00'")
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    tokens = spark.createDataFrame([("a", "r", None, day(1)), ("b", "r", day(-1), day(-2)), ("c", "r", None, day(0)), ("d", "r", None, day(1))], "share_id string, repo_id string, revoked_at timestamp, expires_at timestamp")
    asked = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "r"), ("d", "other"), ("e", "r")], "share_id string, repo_id string")
    assert {r.share_id: r.state for r in jobs.valid_tokens(tokens, asked, now).collect()} == {"a": "valid", "b": "revoked", "c": "expired", "d": "invalid", "e": "invalid"}
    ttl = spark.createDataFrame([(0,), (1,), (30,), (31,)], "d int").select("d", jobs.share_expiry(F.col("d"), now).alias("e")).collect()
    assert {r.d: r.e for r in ttl} == {0: None, 1: day(1), 30: day(30), 31: None}


def test_chat_quality_flags(spark):
    full = "- Purpose: x\n- **Core modules**: a\n* Runtime flow : b\n - Output formats: c\r\n- PRIMARY LANGUAGES: d"
    rows = [
        (1, "summary", full, 1, 5, ""), (2, "Summary", full.replace("Purpose:", "Purpose"), 1, 3, "summary_structure_incomplete"), (3, "summary", full + "\nRepresentative paths include: q", 1, 4, "summary_noise_phrase"),
        (4, "general", "x" * 40, 2, 3, ""), (5, None, "  " + "x" * 39 + "\n", 1, 2, "answer_too_short"), (6, "general", " \n", 0, 0, "empty_answer,missing_citations,answer_too_short"), (7, "summary", None, 0, 1, "empty_answer,missing_citations,summary_structure_incomplete"),
    ]
    frame = spark.createDataFrame([r[:4] for r in rows], "answer_id int, intent string, answer string, citation_count int")
    assert {r.answer_id: (r.score, r.flags, r.passed) for r in evaluation.chat_quality(frame).collect()} == {r[0]: (r[4], r[5], r[5] == "") for r in rows}


RESULT = "query_id int, repo_id string, file_path string, language string, rank int, start_line int, content string"


def test_facets_answers_and_snippets(spark):
    paths = ["src/cli/gif_dataurl.py", "src/api", "app/ web /x.tsx", "/lib/webp/core.json", "docs/a.yml", "src/cli/b.py", "tool", "z.md", "ninth/x.gif"]
    rows = [(1, "r", p, "py" if i % 2 else " TS ", i + 1, 0, " a\n\tb\u00a0 " if i else " \n") for i, p in enumerate(paths)]
    results = spark.createDataFrame(rows, RESULT)
    f = analysis.repo_summary_facets(results).first()
    assert f.modules == ["src/cli", "src/api", "app/web", "lib/webp", "docs"] and f.languages == ["TypeScript", "Python"]
    assert f.outputs == ["GIF", "data URL", "WebP", "web UI views", "structured config/data"]
    assert f.flows == ["CLI entrypoint receives arguments", "request handlers call service modules", "UI components render feature views"]
    assert grounding.snippet_answer(results).first().answer == "Based on indexed code context: src/cli/gif_dataurl.py:1 | src/api:1 -> a b | app/ web /x.tsx:1 -> a b."
    refs = spark.createDataFrame([(2, "r", "a.py:3")], "query_id int, repo_id string, refs string")
    assert grounding.snippet_answer(results, refs=refs).first().answer == "Relevant code context was found in: a.py:3."
    asked = spark.createDataFrame([(1, "r", "Give a summary"), (1, "none", "x")], "query_id int, repo_id string, q string")
    repos = spark.createDataFrame([("r", "o/x", "Go")], "repo_id string, full_name string, language string")
    said = "Repository o/x (branch main) is\n primarily py. The parse/index stage identified 3 source files and 9 chunks. Fine tool. "
    valid = spark.createDataFrame([], "query_id int, repo_id string, rank int, file_path string, line_start int")
    plans = {r.repo_id: r for r in grounding.answer_plan(asked, results, valid, repos, spark.createDataFrame([("r", said)], "repo_id string, summary string")).collect()}
    assert plans["none"].text == "I could not find relevant indexed code context for that query."
    assert plans["r"].text == "\n".join((
        "- Purpose: Repository o/x (branch main) is primarily py. The parse/index stage identified 3 source files and 9 chunks. Fine tool.", "- Core modules: src/cli, src/api, app/web, lib/webp, docs.",
        "- Runtime flow: CLI entrypoint receives arguments; request handlers call service modules; UI components render feature views.",
        "- Output formats: GIF, data URL, WebP, web UI views, structured config/data.", "- Primary languages: TypeScript, Python.",
    ))


def test_architecture_and_suggestions(spark):
    chunks = spark.createDataFrame([("r", f"p{i}.py", 1, 2, "ab", "Py", f"c{i}") for i in range(7)] + [("r", "p0.py", 3, 4, "abc", None, "d")], "repo_id string, file_path string, start_line int, end_line int, content string, language string, chunk_id string")
    repos = spark.createDataFrame([("r", "o/x", "main"), ("e", "o/e", "main")], "repo_id string, full_name string, default_branch string")
    got = {r.repo_id: r for r in analysis.analyze_repos(chunks, repos).collect()}
    assert got["r"].summary == (
        "Repository o/x (branch main) is primarily py. The parse/index stage identified 7 source files and 8 chunks. Representative paths include: p0.py, p1.py, p2.py, p3.py, p4.py. "
        "This summary is generated from structural chunk metadata and should be refined with LLM synthesis in later stages."
    )
    assert got["e"].error_code == "NO_CHUNKS" and got["r"].quality_score == 80
    asked = [r.question for r in grounding.suggested_questions(chunks, 5).orderBy("nth").collect()]
    assert asked[0] == "What are the main architecture components in this repository?" and asked[3:] == ["Explain the responsibilities of `p0.py`.", "Explain the responsibilities of `p1.py`."]


def test_diff_answers_and_lazy_header(spark):
    text = "x\ndiff --git a/a b/c b/a b/c\n@@ -1 +1 @@\n+password"
    diffs = spark.createDataFrame([("r", "0123456789ab", text), ("r", "none", ""), ("r", "null", None)], "repo_id string, head_sha string, diff_text string")
    files = diff.diff_files(diffs)
    assert [(f.old_path, f.path) for f in files.collect()] == [("a", "c b/a b/c")]
    assert {r.head_sha: r.answer for r in diff.diff_fallback_answer(diffs, files).collect()} == {
        "0123456789ab": "This commit (0123456789) changed: c b/a b/c. Security-sensitive areas: password.", "none": "This commit (none) changed: no files.", "null": "This commit (null) changed: no files.",
    }


def test_chunks_need_no_shuffle(spark):
    files = spark.createDataFrame([("r", "a.py", "x"), ("r", "b.md", None)], "repo_id string, file_path string, content string")
    assert "Exchange" not in chunking.chunk_files(files)._jdf.queryExecution().executedPlan().toString()
    assert chunking.chunk_files(files).count() == 1


def test_embedding(spark):
    texts = spark.createDataFrame([("1", "ab"), ("2", "cde"), ("3", "cde")], "chunk_id string, content string")
    now = F.expr("timestamp'2024-01-10 00:00:00'")
    cache = spark.createDataFrame([("m", "ab", [1.0], datetime(2024, 1, 9))], "model string, t string, embedding array<float>, stored_at timestamp").withColumn("content_hash", P.content_hash(F.col("t"))).drop("t")
    asked = []
    embed = lambda df: embedding.embed_with(df, lambda ts: [[float(len(t))] for t in ts])
    done, new = embedding.embed_with_cache(texts, cache, "m", now, embed)
    assert {(r.chunk_id, r.embedding[0]) for r in done.collect()} == {("1", 1.0), ("2", 3.0), ("3", 3.0)} and new.count() == 1 and not asked
    unit = embedding.embed_hashed(texts, 16).first().embedding
    assert abs(sum(x * x for x in unit) - 1) < 1e-6


def test_bucketed_cache(spark):
    """The cache's side of the join isn't shuffled; expired rows and older ones of a hash are gone after compaction."""
    cache = embedding.BucketedCache(spark, "vectors_test", 4)
    texts = spark.range(400).selectExpr("cast(id as string) chunk_id", "concat('text ', id % 200) content")
    now = lambda day: F.lit(f"2024-01-{day:02}").cast("timestamp")
    assert cache.read().count() == 0
    try:
        for day in (1, 2):
            found, new = embedding.embed_with_cache(texts.where(f"cast(substring(content, 6) as int) < {100 * day}"), cache.read(), "m", now(day), lambda t: embedding.embed_hashed(t, 8))
            assert found.count() == 200 * day
            cache.add(new)
        assert cache.read().count() == 200
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found, new = embedding.embed_with_cache(texts, cache.read(), "m", now(3), lambda t: embedding.embed_hashed(t, 8))
        assert found.count() == 400 and new.count() == 0
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        met = found._jdf.queryExecution().executedPlan().toString()
        above, inside = [], 0
        for line in met.splitlines():
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [(d, t) for d, t in above if d < depth] + [(depth, line)]
            if "vectors_test_g1" in line:
                inside += 1
                joined = next(i for i in range(len(above) - 1, -1, -1) if "Join" in above[i][1])
                assert not any("Exchange" in t for _, t in above[joined:])
        assert inside >= 1
        cache.add(new.union(spark.createDataFrame([("m", "h", [2.0], datetime(2024, 1, 1)), ("m", "h", [3.0], datetime(2024, 1, 3)), ("n", "h", [4.0], datetime(2024, 1, 3))], embedding.BucketedCache.SCHEMA)))
        cache.compact(now(9), 7 * 86_400)
        left = cache.read()
        assert cache.generations() == [2] and left.count() == 102 and left.where("stored_at < timestamp'2024-01-02'").count() == 0
        assert {(r.model, r.embedding[0]) for r in left.where("content_hash = 'h'").collect()} == {("m", 3.0), ("n", 4.0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        for g in cache.generations():
            spark.sql(f"drop table vectors_test_g{g}")


def run_stream(spark, frame, schema, make, tmp_path, name):
    """The rows of a stream over frame, dealt in three files."""
    for i in range(3):
        frame.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / (name + "-state"))).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def shuffled(frame, order):
    """frame dealt over three files by a hash of its rows, with one more row, an hour later, in the last one, which lets the watermark pass all others."""
    last = frame.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + interval 1 hour")).withColumn(order, F.lit(999_999).cast("long"))
    return frame.withColumn("part", F.pmod(F.xxhash64(order), F.lit(3))).unionByName(last.withColumn("part", F.lit(2).cast("long")))


def test_status_changes_stream_equals_batch(spark, tmp_path):
    """States that come in any order over several micro-batches give what the batch twin gives."""
    base = datetime(2024, 1, 1)
    states = ["queued", "queued", "parsing", "parsing", "done", "parsing"]
    rows = [(f"j{j}", 10 * j + i, states[i] if j else states[min(i, 3)], 0, None, base + timedelta(seconds=i)) for j in range(3) for i in range(6)]
    frame = spark.createDataFrame(rows, "job_id string, event_id long, status string, progress int, error_message string, ts timestamp")
    want = sorted(map(tuple, jobs.status_changes(frame).collect()))
    dealt = shuffled(frame, "event_id")
    got = run_stream(spark, dealt, dealt.drop("part").schema, streams.status_changes_stream, tmp_path, "changes")
    assert sorted(map(tuple, got.where("event_id < 999999").select("job_id", "event_id", "status", "progress").collect())) == want and len(want) == 8


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    """Shuffled requests of both types of identity, over several micro-batches."""
    base = datetime(2024, 1, 1)
    rows = [("chat", kind, f"u{u}", 1000 * n + 100 * u + i, base + timedelta(seconds=20 * i * (u + 1))) for n, kind in enumerate(("auth", "guest", "other")) for u in range(2) for i in range(12)]
    frame = spark.createDataFrame(rows, "scope string, identity_type string, identity string, request_id long, ts timestamp")
    limits = {"auth": 4, "guest": 2}
    want = sorted(map(tuple, jobs.rate_limit_audit(frame, limits, 100).collect()))
    assert [sum(r[4] for r in want if r[1] == kind) for kind in ("auth", "guest", "other")] == [22, 14, 14] and jobs.LIMITS == {"auth": 50, "guest": 10}
    dealt = shuffled(frame, "request_id")
    got = run_stream(spark, dealt, dealt.drop("part").schema, lambda s: streams.rate_limit_stream(s, limits, 100), tmp_path, "limits")
    assert sorted(map(tuple, got.where("request_id < 999999").collect())) == want


def test_rate_limit_audit_folds_a_hot_identity_across_batches(spark):
    rows = spark.range(30_000).selectExpr("'chat' scope", "'guest' identity_type", "if(id % 10 = 0, concat('u', id % 70), 'hot') identity", "id request_id", "if(id < 20, null, timestamp_seconds(id * 7919 % 10007)) ts")
    audit = jobs.rate_limit_audit(rows, {"guest": 3}, 100)
    assert "collect_list" not in audit._jdf.queryExecution().toString()
    want, state = {}, {}
    for r in sorted(rows.selectExpr("identity", "request_id", "unix_micros(ts) div 1000000 at").collect(), key=lambda r: (r.at is not None, r.at or 0, r.request_id)):
        start, n = state.get(r.identity, (None, 0))
        start, n = (r.at, 1) if start is None or r.at >= start + 100 else (start, n + 1)
        state[r.identity] = start, n
        want[r.request_id] = (r.identity, n <= 3, max(3 - n, 0))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = audit.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 30_000 and {r.request_id: (r.identity, r.allowed, r.remaining) for r in got} == want


def test_stream_state_expires(spark, tmp_path):
    """The same state again is no change, unless the job's was dropped by the event time that other jobs brought."""
    base = datetime(2024, 1, 1)
    row = lambda job, n, minute: (job, n, "queued", 0, None, base + timedelta(minutes=minute))
    schema = "job_id string, event_id long, status string, progress int, error_message string, ts timestamp"
    found = []
    for name, keep in (("kept", 36_000), ("gone", 60)):
        for i, rows in enumerate(([row("j", 1, 0), row("x", 2, 30)], [row("x", 3, 60)], [row("j", 4, 65), row("x", 5, 120)])):
            spark.createDataFrame([(*r, i) for r in rows], schema + ", part int").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            q = streams.status_changes_stream(spark.readStream.schema(schema).parquet(str(tmp_path / name)), "1 minute", keep).writeStream.format("parquet").option("path", str(tmp_path / (name + "-out"))).option("checkpointLocation", str(tmp_path / (name + "-state"))).trigger(availableNow=True).start()
            q.awaitTermination(120)
        found.append(sorted(r.event_id for r in spark.read.parquet(str(tmp_path / (name + "-out"))).where("job_id = 'j'").collect()))
    assert found == [[1], [1, 4]]


def test_dedupe_requests_in_order(spark, tmp_path):
    """Requests see what those before them made, in a batch and, shuffled, on a stream."""
    day = lambda n: datetime(2024, 1, 1, 0, 0, n)
    asked = [
        (1, "r", "new", "k", False, day(1)), (2, "r", "new", "other", False, day(2)), (3, "r", "new", "k", True, day(3)), (4, "r", "new", "k", False, day(4)), (5, "r", "new", None, False, day(5)), (6, "r", "new", "other", False, day(6)),
        (7, "r", "old", "k", False, day(1)), (8, "r", "old", "", False, day(2)), (9, "r", "old", "", True, day(3)), (10, "r", "old", "k", False, day(4)), (11, "r", "bad", "k", False, day(1)), (12, "r", "bad", "x", False, day(2)), (13, "r", "bad", "y", False, day(3)),
    ]
    known = [("a", "r", "old", "k", "done", day(0)), ("b", "r", "old", "z", "queued", day(1)), ("c", "r", "bad", "k", "failed", day(0))]
    requests = spark.createDataFrame(asked, "request_id long, repo_id string, commit_sha string, idempotency_key string, force boolean, ts timestamp")
    there = spark.createDataFrame(known, "job_id string, repo_id string, commit_sha string, idempotency_key string, status string, created_at timestamp")
    got = {r.request_id: (r.job_id, r.cache_hit, r.created) for r in jobs.dedupe_requests(requests, there).collect()}
    assert got == {
        1: ("job-1", False, True), 2: ("job-1", False, False), 3: ("job-3", False, True), 4: ("job-3", False, False), 5: ("job-3", False, False), 6: ("job-3", False, False),
        7: ("a", True, False), 8: ("b", False, False), 9: ("job-9", False, True), 10: ("a", True, False), 11: ("c", False, False), 12: ("job-12", False, True), 13: ("job-12", False, False),
    }
    dealt = shuffled(requests, "request_id")
    streamed = run_stream(spark, dealt, dealt.drop("part").schema, lambda s: streams.dedupe_requests_stream(s, there), tmp_path, "dedupe")
    assert {r.request_id: (r.job_id, r.cache_hit, r.created) for r in streamed.where("request_id < 999999").collect()} == got


class Killed(Exception):
    pass


def corpus_inputs(spark):
    rows = [("j1", "r1", "src/a.py", "import os\n\ndef f():\n    return 1\n", 0), ("j1", "r1", "README.md", "words here", 0), ("j1", "r1", "x.bin", "no source", 0), ("j2", "r2", "x.bin", "no source", 0), ("j3", "r3", "a.py", "x = 1", 0), ("j3", "r3", "b.py", "x = 2", 0), ("j3", "r3", "c.py", "x = 3", 0)]
    repos = spark.createDataFrame([(r, f"o/{r}", "main") for r in ("r1", "r2", "r3", "r4")], "repo_id string, full_name string, default_branch string")
    return spark.createDataFrame(rows, "job_id string, repo_id string, file_path string, content string, retry_count int"), repos


def stored(spark, store):
    return {name: sorted(map(spell, store.read(spark, name).drop("stored_at", "created_at", "completed_at").collect())) for name in streams.CORPUS_TABLES}


def test_corpus_job(spark, tmp_path):
    frame, repos = corpus_inputs(spark)
    store = streams.CorpusStore(str(tmp_path / "store"), dim=16, max_files=2)
    for i in range(2):
        frame.withColumn("content", F.concat("content", F.lit("\n" * i))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.corpus_job(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), repos, store, str(tmp_path / "cp")).awaitTermination(300)
    table = lambda name: store.read(spark, name)
    assert {r.repo_id for r in table("chunks").collect()} == {"r1"} and table("chunks").count() == table("vectors").count() == 3
    assert {len(r.embedding) for r in table("vectors").collect()} == {16}
    assert [(r.job_id, r.repo_id) for r in table("results").collect()] == [("j1", "r1")]
    assert {(r.job_id, r.stage, r.error_code) for r in table("dead_letters").collect()} == {("j2", "embedding", "NO_CHUNKS"), ("j3", "parsing", "FILE_LIMIT_EXCEEDED")}
    assert table("dead_letters").count() == 4 and {(r.job_id, r.status) for r in table("jobs").collect()} == {("j1", "done"), ("j2", "failed"), ("j3", "failed")}
    assert table("cache").groupBy("content_hash").count().where("count > 1").count() == 0
    steps = {j: [(r.status, r.progress) for r in table("progress").where(F.col("job_id") == j).orderBy("step").dropDuplicates(["step"]).orderBy("step").collect()] for j in ("j1", "j2", "j3")}
    assert steps["j3"] == [("parsing", 10), ("parsing", 30)] and steps["j2"] == [*steps["j3"], ("parsing", 80), ("embedding", 100), ("embedding", 10)]
    assert steps["j1"] == [*steps["j2"], ("embedding", 40), ("embedding", 90), ("analyzing", 100), ("analyzing", 10), ("analyzing", 80), ("done", 100)]


def test_corpus_job_killed_after_any_write(spark, tmp_path, monkeypatch):
    """Whatever write a batch is killed after, nothing of it is visible, and its next run leaves what one run would. A batch that is done changes nothing."""
    frame, repos = corpus_inputs(spark)
    now = F.lit("2024-01-01").cast("timestamp")
    second = frame.withColumn("content", F.concat("content", F.lit("\ny = 2")))
    good, torn = (streams.CorpusStore(str(tmp_path / n), dim=8, max_files=2, buckets=4) for n in ("good", "torn"))
    for store in (good, torn):
        assert streams.run_corpus_job(frame, repos, store, now, "s", 0)
    before = stored(spark, torn)
    assert streams.run_corpus_job(second, repos, good, now, "s", 1) and stored(spark, good) != before
    real, writes = snapshots.Batch._write, []

    def write(self, name, rows, touched):
        real(self, name, rows, touched)
        writes.append(name)
        if len(writes) == stop:
            raise Killed

    monkeypatch.setattr(snapshots.Batch, "_write", write)
    for stop in (1, 4, 7):
        writes.clear()
        with pytest.raises(Killed):
            streams.run_corpus_job(second, repos, torn, now, "s", 1)
        assert stored(spark, torn) == before
    stop = 0
    assert streams.run_corpus_job(second, repos, torn, now, "s", 1) and stored(spark, torn) == stored(spark, good)
    assert not streams.run_corpus_job(second, repos, torn, now, "s", 1) and not streams.run_corpus_job(frame, repos, torn, now, "s", 0)
    assert stored(spark, torn) == stored(spark, good) and torn.tables.versions(spark) == [1, 2]
    torn.tables.expire(spark, 1)
    assert torn.tables.versions(spark) == [2] and stored(spark, torn) == stored(spark, good)


def test_upsert_leaves_untouched_buckets(spark, tmp_path):
    """A merge reads and writes the touched buckets alone; the files of others stay as they are."""
    kinds = {"results": snapshots.StoredTable("job_id string, quality_score long, created_at timestamp", "job_id"), "log": snapshots.StoredTable("n long")}
    store = snapshots.SnapshotStore(str(tmp_path), kinds, buckets=8)
    row = lambda i, q, day: (f"j{i}", q, datetime(2024, 1, day))
    frame = lambda rows: spark.createDataFrame(rows, kinds["results"].schema)
    first = snapshots.Batch(spark, store, "s", 0)
    first.merge("results", frame([row(i, i, 1) for i in range(100)]), tables.upsert_analysis)
    first.commit()
    files = lambda: {p: os.stat(p).st_mtime_ns for p in map(str, tmp_path.glob("data/results/*/*/*.parquet"))}
    old = files()
    assert store.read(spark, "results").count() == 100 and len(store.manifest(spark).tables["results"]) == 8
    second = snapshots.Batch(spark, store, "s", 1)
    seen = []
    second.merge("results", frame([row(3, 99, 2), row(3, 98, 1)]), lambda a, b: seen.append(a.inputFiles()) or tables.upsert_analysis(a, b))
    second.append("log", spark.range(3).withColumnRenamed("id", "n"))
    second.commit()
    assert {p: t for p, t in files().items() if p in old} == old
    one = {p.rsplit("/", 2)[1] for p in files() if p not in old}
    assert len(one) == 1 and {f.rsplit("/", 2)[1] for f in seen[0]} == one
    now = {r.job_id: r.quality_score for r in store.read(spark, "results").collect()}
    assert len(now) == 100 and now["j3"] == 99 and now["j4"] == 4
    for i in range(2, 14):  # appended folders become one
        more = snapshots.Batch(spark, store, "s", i)
        more.append("log", spark.range(2).withColumnRenamed("id", "n"))
        more.commit()
    assert store.read(spark, "log").count() == 3 + 24 and len(store.manifest(spark).tables["log"]) <= 8
    with pytest.raises(RuntimeError):
        stale = snapshots.Batch(spark, store, "other", 0)
        stale.made.version = 1
        stale.commit()


def test_percentile(spark):
    rows = spark.range(1, 11).selectExpr("'a' g", "cast(id as double) v").union(spark.sql("select 'b', double(null)")).union(spark.range(1000).selectExpr("'c'", "double(id % 7)"))
    got = {(r.g, r.percent): r.value for r in evaluation.nearest_rank(rows, "v", (50, 95, 100, 0), ("g",)).collect()}
    assert got == {("a", 95.0): 10.0, ("a", 50.0): 5.0, ("a", 100.0): 10.0, ("a", 0.0): 1.0, ("c", 50.0): 3.0, ("c", 95.0): 6.0, ("c", 100.0): 6.0, ("c", 0.0): 0.0}


def test_repositories_keep_the_first_id(spark):
    fields = tables.REPOSITORY_FIELDS
    schema = "full_name string, id string, " + ", ".join(f"{f} string" for f in fields)
    old = spark.createDataFrame([("a", "1", *["o"] * len(fields)), ("b", "2", *["o"] * len(fields))], schema)
    new = spark.createDataFrame([("a", "9", *["n"] * (len(fields) - 1), None, 2), ("a", "8", *["m"] * len(fields), 1), ("c", "7", *["n"] * len(fields), 1)], schema + ", snapshot_at int")
    got = {r.full_name: r for r in tables.upsert_repositories(old, new).collect()}
    assert (got["a"].id, got["a"].stars, got["a"].size_kb, got["b"].stars, got["c"].id) == ("1", "n", None, "o", "7")


def test_client_events(spark):
    rows = [('{"event":"route_load","route":"/a","duration_ms":5}',), ("{bad",), ('{"duration_ms":"x"}',)]
    raw = spark.createDataFrame(rows, "payload string")
    assert [(r.event, r.route, r.duration_ms) for r in P.client_events(raw).collect()] == [("route_load", "/a", 5.0), ("unknown", "", None)]
    assert [r.metadata for r in P.client_events(raw.selectExpr("payload").union(spark.sql('select \'{"metadata":{"a":[1]}}\''))).collect()] == ["{}", "{}", '{"a":[1]}']
    assert P.rejected_events(raw).count() == 1
