import json
import os
import threading
import urllib.error
import urllib.request
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from govlake import api, client
from govlake.functions import scalars as fn
from govlake.plans import nlsql, semantic
from govlake.plans.sqlgate import Gate, Rejected, lift_aliases, shim_functions, strip_catalog
from govlake.sources import catalog, ingest
from govlake.streaming.ingest import ingest_new_files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert one(spark, fn.brl(lit(1234567.891))) == "R$ 1.234.567,89" and one(spark, fn.brl(lit(-219775.48))) == "R$ -219.775,48"
    assert one(spark, fn.safe_div(lit(1), lit(0))) is None
    assert [one(spark, fn.age_band(lit(a))) for a in (0, 17, 18, 64, 65, 99)] == ["0-17", "0-17", "18-24", "55-64", "65+", "65+"]
    assert [one(spark, fn.type_abbrev(lit(t))) for t in ("STRING", "BIGINT", "INTERVAL", "DOUBLE", "DATE", "TIMESTAMP", "TIME", "BOOLEAN", "DECIMAL(5,2)", "BLOB")] == ["V", "I", "I", "D", "Dt", "Ts", "Ti", "B", "Dec", "BLOB"]
    assert [one(spark, fn.human_size(lit(n))) for n in (0, 1023, 1024, 5 * 1024**3, 3 * 1024**5)] == ["0.0 B", "1023.0 B", "1.0 KB", "5.0 GB", "3072.0 TB"]
    assert one(spark, fn.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(0.0)))) == 0.0
    assert one(spark, fn.mask_person_id(lit("123.456.789-01"))) == "***456789**"
    assert one(spark, fn.csv_line(lit(1), lit(None).cast("string"), lit("b"))) == "1,,b"
    assert one(spark, fn.value_text(lit(b"abc"), "binary")) == "<blob 3 bytes>" and one(spark, fn.value_text(lit(None).cast("int"))) == "NULL"
    fn.register_functions(spark)
    assert spark.sql("SELECT brl(1234.5D) AS x, company_root('11.222.333/0001-44') AS y").first() == ("R$ 1.234,50", "11222333")


def test_text_clean_up():
    assert nlsql.clean_sql("<think>no</think>\n```sql\nSELECT 1;\n```") == "SELECT 1"
    assert nlsql.clean_sql("```sql\nSELECT 1") == "SELECT 1" and nlsql.clean_sql("SELECT 2;") == "SELECT 2"
    assert nlsql.ensure_sql("with a as (select 1) select * from a").startswith("with")
    assert nlsql.ensure_sql("it's unknown") == "SELECT 'it\\'s unknown' AS resposta"
    assert nlsql.wrap_words("aa bb cc\n\ndd", 5) == ["aa bb", "cc", "", "dd"]
    assert nlsql.duration(75) == "1m 15s" and nlsql.duration(1.5) == "1.50s"


def test_states():
    S, E = nlsql.State, nlsql.Event
    assert nlsql.step(S.INPUT, E.ASKED) is S.GENERATING and nlsql.step(S.RUNNING, E.FAILED, 2) is S.RETRYING
    assert nlsql.step(S.RUNNING, E.FAILED, 3) is S.ERROR and nlsql.step(S.DONE, E.RESET) is S.INPUT and nlsql.step(S.DONE, E.FAILED) is S.DONE


def test_shims(spark):
    assert strip_catalog("SELECT * FROM lake.ds.t WHERE x = 'lake.ds.t'", ("lake",)) == "SELECT * FROM ds.t WHERE x = 'lake.ds.t'"
    run = lambda sql: spark.sql(shim_functions(sql)).first()[0]
    assert run("SELECT regexp_contains('obras', 'obra|x')") is True and run("SELECT starts_with('abc', 'ab')") is True
    assert run("SELECT date_diff('day', DATE '2020-01-01', DATE '2020-02-01')") == 31
    assert run("SELECT regexp_replace('a-b-c', '-', '', 'g')") == "abc" and run("SELECT regexp_replace('a-b-c', '-', '')") == "ab-c"
    assert run("SELECT regexp_replace('ab', '(a)(b)', '\\\\2\\\\1', 'g')") == "ba"
    assert spark.sql(shim_functions("SELECT * FROM range(50) USING SAMPLE 2 ROWS")).count() == 2


def test_alias_lifting(spark):
    sql = "SELECT id, id * 2 AS twice FROM range(10) WHERE twice > 10 AND id < 9 ORDER BY id DESC LIMIT 2"
    assert [r.id for r in spark.sql(lift_aliases(sql)).collect()] == [8, 7]
    plain = "SELECT id FROM range(3) WHERE id > 1"
    assert lift_aliases(plain) == plain


@pytest.mark.parametrize(
    "sql",
    ["DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE t (a INT)", "SELECT 1; SELECT 2", "SET a=b", "DELETE FROM t", "CACHE TABLE t", "not sql at all", "CREATE OR REPLACE TEMPORARY VIEW v AS SELECT 1", "TRUNCATE TABLE t", "SHOW TABLES"],
)
def test_gate_rejects(spark, sql):
    with pytest.raises(Rejected):
        Gate(spark).run(sql)


def test_gate_runs_queries(spark):
    spark.range(5).createOrReplaceTempView("big")
    gate = Gate(spark, catalogs=("lake",), large={"big": ("ano", "id")})
    assert gate.run("WITH a AS (SELECT 1 AS x) SELECT x AS drop_table FROM a;").first()[0] == 1
    assert gate.run("SELECT ';' AS x").first()[0] == ";"
    with pytest.raises(Rejected, match="filter big"):
        gate.run("SELECT count(*) FROM big")
    assert gate.run("SELECT count(*) FROM big WHERE id > 2").first()[0] == 2
    assert Gate(spark, large={"big": ("ano",)}, full_scans=frozenset({"big"})).run("SELECT count(*) FROM big").first()[0] == 5


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT reflect('java.lang.System', 'getenv')",
        "SELECT 1 WHERE EXISTS (SELECT try_reflect('java.lang.System', 'getProperty', 'user.home'))",
        "WITH a AS (SELECT builtin.reflect('java.lang.System', 'getenv') AS x) SELECT * FROM a",
        "SELECT upper(x) FROM VALUES (java_method('java.lang.System', 'getProperty', 'user.home')) t(x)",
        "SELECT input_file_name() FROM range(2)",
        "SELECT * FROM text.`file:///etc/hostname`",
        "SELECT * FROM csv.`/etc/passwd`",
        "SELECT 1 WHERE 1 IN (SELECT length(value) FROM text.`/etc/hostname`)",
        "SELECT * FROM parquet.`/elsewhere/x`",
        "SELECT * FROM parquet.`/lake/../elsewhere/x`",
        "SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/hostname`",
        "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
        "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM range(3)",
        "SELECT * FROM python_worker_logs()",
        "EXPLAIN DROP TABLE t",
    ],
)
def test_gate_lets_nobody_out(spark, sql):
    with pytest.raises(Rejected):
        Gate(spark, roots=("/lake",)).run(sql)


def test_gate_knows_queries(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/t")
    gate = Gate(spark, roots=(str(tmp_path),))
    fn.register_functions(spark)
    for sql, rows in (
        (f"SELECT count(*) FROM parquet.`{tmp_path}/t` WHERE id IN (SELECT id FROM range(2))", 1),
        ("SELECT x, sum(y) OVER (PARTITION BY x ORDER BY y) FROM VALUES (1, 2), (1, 3) t(x, y)", 2),
        ("SELECT * FROM (SELECT id % 2 AS k, id FROM range(6)) PIVOT (sum(id) FOR k IN (0, 1))", 1),
        ("SELECT id, e FROM range(2) LATERAL VIEW explode(array(1, 2)) t AS e", 4),
        ("SELECT id FROM (SELECT * FROM range(5)) TABLESAMPLE (3 ROWS)", 3),
        ("(SELECT 1 AS a UNION SELECT 2) EXCEPT SELECT 2 INTERSECT SELECT 2", 1),
        ("SELECT k, count(*) AS n FROM (SELECT id % 3 AS k FROM range(9)) GROUP BY ROLLUP (k) HAVING n > 1 ORDER BY 1 LIMIT 10 OFFSET 1", 3),
        ("SELECT /*+ BROADCAST(b) */ a.id, brl(1.5D), (SELECT max(id) FROM range(3)) FROM range(3) a JOIN range(2) b USING (id)", 2),
        ("SELECT a.id FROM range(3) a, LATERAL (SELECT a.id + 1 AS y) WHERE CASE WHEN y > 1 THEN true END", 2),
        ("FROM range(3)", 3),
        ("DESCRIBE SELECT 1 AS x", 1),
        ("EXPLAIN SELECT 1", 1),
    ):
        assert gate.run(sql).count() == rows, sql


def test_guard_reads_the_plan(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 4 AS ano").write.partitionBy("ano").parquet(f"{tmp_path}/ds/big")
    catalog.Catalog(spark).build(str(tmp_path))
    try:
        gate = Gate(spark, large={"ds.big": ("ano",)})
        for sql in (
            "SELECT count(*) FROM ds.big",
            "SELECT a.id FROM ds.big a JOIN (SELECT 1 AS ano) b ON b.ano = 1",
            "SELECT count(*) FROM ds.big WHERE id > 0 OR ano = 1",
            "SELECT count(*) FROM ds.big WHERE ano IS NOT NULL AND ano <> 3",
            "SELECT (SELECT count(*) FROM ds.big) AS n",
            "SELECT id FROM ds.big WHERE ano = 1 UNION ALL SELECT id FROM ds.big",
            "WITH big AS (SELECT * FROM ds.big) SELECT id FROM big LIMIT 1",
            "SELECT 'WHERE ano = 1' AS x, id FROM ds.big",
        ):
            with pytest.raises(Rejected, match="filter ds.big on ano"):
                gate.run(sql)
        for sql, n in (
            ("SELECT id FROM ds.big WHERE ano = 1", 5),
            ("SELECT id FROM ds.big WHERE ano BETWEEN 1 AND 2 AND id > 9", 5),
            ("WITH a AS (SELECT * FROM ds.big) SELECT id FROM a WHERE ano IN (1, 3)", 10),
            ("SELECT a.id FROM ds.big a JOIN ds.big b ON a.ano = b.ano AND a.id = b.id WHERE b.ano = 2", 5),
            ("SELECT id AS big FROM range(2)", 2),
        ):
            assert gate.run(sql).count() == n, sql
        assert Gate(spark, large={"ds.big": ("ano",)}, full_scans=frozenset({"ds.big"})).run("SELECT * FROM ds.big").count() == 20
    finally:
        spark.sql("DROP DATABASE IF EXISTS ds CASCADE")


def test_views_have_all_columns(spark, tmp_path):
    spark.range(2).selectExpr("id", "id AS ano").write.parquet(f"{tmp_path}/ds/t")
    spark.range(3).selectExpr("id", "'x' AS extra", "id AS ano").write.mode("append").parquet(f"{tmp_path}/ds/t")
    try:
        assert catalog.Catalog(spark).build(str(tmp_path)) == ["ds.t"]
        rows = spark.table("ds.t")
        assert set(rows.columns) == {"id", "ano", "extra"} and rows.filter("extra IS NULL").count() == 2
    finally:
        spark.sql("DROP DATABASE IF EXISTS ds CASCADE")


def test_asker_retries_with_the_error(spark, tmp_path):
    asked = []
    replies = iter(["SELECT nope FROM range(3)", "SELECT also_nope FROM range(3)", "```sql\nSELECT count(*) AS n FROM range(3)\n```"])
    generator = nlsql.CallableGenerator(lambda q, s, p: asked.append(q) or next(replies))
    log = str(tmp_path / "log")
    asker = nlsql.Asker(Gate(spark), generator, lambda q: "schema", nlsql.table_log(spark, log))
    answer = asker.ask("how many?")
    assert answer.error is None and answer.df.first().n == 3 and answer.tries == 2
    assert "nope" in asked[1] and asked[0] == "how many?"
    assert [(r.question, r.success) for r in spark.read.parquet(log).collect()] == [("how many?", True)]
    bad = nlsql.Asker(Gate(spark), nlsql.CallableGenerator(lambda q, s, p: "SELECT nope"), lambda q: "")
    assert bad.ask("x").error and bad.states[-1] is nlsql.State.ERROR


def test_semantic_layer(spark):
    emb = semantic.HashingEmbedder()
    index = spark.createDataFrame([(n, n, emb.embed(n)) for n in ("school census", "company owners", "school exam")], "id string, text string, embedding array<double>")
    got = semantic.cosine_select(index, emb.embed("school census"), 0.35).collect()
    assert [r.id for r in got] == ["school census", "school exam"] and got[0].similarity == pytest.approx(1)
    assert semantic.cosine_select(index, emb.embed("school census"), 0.35, 1).count() == 1
    assert semantic.texts_by_id(index, ["school exam", "none", "company owners"]) == ["school exam", "company owners"]
    objects, links = semantic.ontology(spark)
    names = {r.object for r in objects.collect()}
    assert all(r.source in names and r.target in names for r in links.collect())
    assert semantic.table_names("# x\na.b: c:V\nd.e: f:I") == ["a.b", "d.e"]


def test_catalog(spark, tmp_path):
    root = str(tmp_path)
    spark.range(10).selectExpr("id", "id % 2 AS ano").write.partitionBy("ano").parquet(f"{root}/ds_one/t_one")
    spark.range(3).selectExpr("id", "'x' AS extra").write.parquet(f"{root}/ds_one/t_two")
    spark.range(2).selectExpr("cast('g' AS binary) AS geometry").write.parquet(f"{root}/ds_one/geo")
    cat = catalog.Catalog(spark, hot=("ds_one.t_one", "ds_one.none"))
    try:
        assert cat.build(root) == ["ds_one.t_one", "ds_one.t_two"]
        df = spark.sql("SELECT * FROM ds_one.t_one WHERE ano = 1")
        assert df.count() == 5 and "PartitionFilters: [isnotnull(ano" in df._jdf.queryExecution().executedPlan().toString()
        assert {r.table_name for r in cat.tables().filter("schema_name = 'ds_one'").collect()} == {"t_one", "t_two"}
        assert cat.warm() == {"ds_one.t_one": True, "ds_one.none": False} and cat.describe("SELECT id FROM ds_one.t_two") == ["id"]
        cat.materialize("ds_one.t_two", f"{root}/out/t_two")
        assert spark.read.parquet(f"{root}/out/t_two").count() == 3
    finally:
        spark.sql("DROP DATABASE IF EXISTS ds_one CASCADE")
    inv = catalog.inventory(catalog.list_files(spark, root))
    text = catalog.tree_markdown(inv)
    assert "## ds_one" in text and "- t_two: " in text and "**Total**" in text
    reg = catalog.registry(spark, {"ds_one.t_two": f"{root}/ds_one/t_two"})
    assert json.loads(catalog.registry_json(reg)) == {"ds_one": {"t_two": [{"name": "id", "type": "BIGINT", "description": None}, {"name": "extra", "type": "STRING", "description": None}]}}
    catalog.write_registry_json(reg, f"{root}/reg")
    assert spark.read.json(f"{root}/reg").count() == 1
    assert "ds_one.t_two: id:I extra:V" in semantic.schema_prompt(reg)
    a = cat.read([f"{root}/ds_one/t_one/ano=1"], base=f"{root}/ds_one/t_one")
    assert a.columns == ["id", "ano"] and a.count() == 5


def test_sizes_of_a_tree(spark, tmp_path):
    """Totals above a terabyte and ties of the one decimal, as the SQL of tree_markdown has them."""
    import duckdb

    from govlake.queries import ORACLE_SQL, QUERIES

    path = f"{tmp_path}/orders.parquet"
    prices = (("F", "a", 1280), ("F", "b", 1792), ("F", "c", 1024**2 * 5 // 4), ("O", "a", 1024**4 - 1), ("O", "b", 3 * 1024**4), ("P", "c", 0))
    spark.createDataFrame([(i, s, p, float(n)) for i, (s, p, n) in enumerate(prices)], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    got = [r.line for r in QUERIES["tree_markdown"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(r[0] for r in con.execute(ORACLE_SQL["tree_markdown"]).fetchall())
    assert "- a: 1 files, 1.2 KB" in got and "- b: 1 files, 3072.0 GB" in got and "**Total**: 6 files, 4096.0 GB" in got
    assert [one(spark, fn.human_size(F.lit(n))) for n in (1280, 1792, 4 * 1024**4)] == ["1.2 KB", "1.8 KB", "4.0 TB"] and one(spark, fn.human_size(F.lit(None))) is None


def test_sinks(spark):
    df = spark.createDataFrame([(1, Decimal("2.50"), date(2020, 1, 2), None)], "a int, b decimal(5,2), c date, d string")
    assert json.loads(catalog.rows_as_json(df).first().json) == {"a": 1, "b": 2.5, "c": "2020-01-02", "d": None}
    assert catalog.box_table(df.select("a")).splitlines()[1] == "| a |" and catalog.box_table(df.limit(0)) == "(no rows)"
    assert catalog.sample_text(df).splitlines()[0] == "a:int,b:decimal(5,2),c:date,d:string"


def test_ingestion(spark, tmp_path):
    tried = []

    def flaky():
        tried.append(1)
        if len(tried) < 2:
            raise OSError("connection reset")
        return spark.range(3)

    def denied():
        raise OSError("Access Denied: 403")

    got = ingest.export_all(spark, {"a.x": flaky, "a.y": denied, "a.z": flaky}, str(tmp_path), {"a.z"}, pause=0)
    assert got == {"a.x": "DONE", "a.y": "ACCESS_DENIED"} and spark.read.parquet(f"{tmp_path}/a/x").count() == 3
    wanted, done = spark.createDataFrame([("a",), ("b",)], "table string"), spark.createDataFrame([("a",)], "table string")
    assert [r.table for r in ingest.pending(wanted, done).collect()] == ["b"]


def test_incremental_files(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(4).write.parquet(source)
    schema = spark.read.parquet(source).schema
    assert ingest_new_files(spark, source, target, mark, schema) == 4
    assert ingest_new_files(spark, source, target, mark, schema) == 0
    spark.range(2).write.mode("append").parquet(source)
    assert ingest_new_files(spark, source, target, mark, schema) == 2 and spark.read.parquet(target).count() == 6


def test_tokens():
    today = date(2024, 5, 1)
    assert api.day_token("s", today) != api.day_token("s", today + timedelta(days=1)) and not api.valid_token("s", "x")
    assert api.valid_token("s", api.day_token("s"))


class NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def test_http(spark):
    server = api.make_server(Gate(spark), "secret", port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, data=None, password="secret"):
        request = urllib.request.Request(base + path, data=data, headers={"X-Password": password})
        with urllib.request.urlopen(request) as r:
            return r.status, r.read().decode()

    try:
        assert call("/health")[0] == 200
        assert json.loads(call("/query?q=SELECT+1+AS+x")[1]) == [{"x": 1}]
        assert json.loads(call("/query", b"SELECT DATE '2020-01-02' AS d")[1]) == [{"d": "2020-01-02"}]
        assert "error" in json.loads(call("/query", b"DROP TABLE x")[1])
        assert "form" in call("/auth")[1]  # sent on to the login page
        assert len(json.loads(call("/query", b"SELECT id FROM range(150000)")[1])) == 150_000
        cookie = None
        try:
            opener = urllib.request.build_opener(NoRedirect())
            opener.open(urllib.request.Request(base + "/login", data=b"password=secret"))
        except urllib.error.HTTPError as e:
            assert e.code == 302
            cookie = e.headers["Set-Cookie"].split(";")[0]
        with urllib.request.urlopen(urllib.request.Request(base + "/auth", headers={"Cookie": cookie})) as r:
            assert r.status == 200 and r.read() == b""
        assert json.loads(client.ask(base, "secret", "SELECT 2 AS x", "get")) == json.loads(client.post(base, "secret", "SELECT 2 AS x")) == [{"x": 2}]
        for path, data, password, code in (("/query", b"SELECT 1", "no", 401), ("/query", b" ", "secret", 400), ("/none", None, "secret", 404), ("/login", b"password=no", "secret", 401)):
            with pytest.raises(urllib.error.HTTPError) as e:
                call(path, data, password)
            assert e.value.code == code
    finally:
        server.shutdown()


def test_client_against_closed_port():
    with pytest.raises(urllib.error.URLError):
        client.post("http://127.0.0.1:9", "x", "SELECT 1", timeout=2)
    assert os.path.exists(client.__file__)


def test_back_ends():
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization") or self.headers.get("X-goog-api-key"), body))
            reply = "```sql\nSELECT 1;\n```"
            made = {"candidates": [{"content": {"parts": [{"text": reply}]}}], "choices": [{"message": {"content": reply}}], "response": reply}
            data = json.dumps(made).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        for kind in ("contents", "chat", "completion"):
            made = nlsql.generator_from_environment({"SQL_GENERATOR": kind, "SQL_GENERATOR_URL": url + "/", "SQL_GENERATOR_MODEL": "m", "SQL_GENERATOR_KEY": "k"})
            assert made.generate("how many?", "t: a:V", nlsql.PROMPT) == "SELECT 1"
    finally:
        server.shutdown()
    assert [(p, k) for p, k, _ in seen] == [("/models/m:generateContent", "k"), ("/chat/completions", "Bearer k"), ("/api/generate", None)]
    assert all("how many?" in json.dumps(b) and "t: a:V" in json.dumps(b) for _, _, b in seen)
    made = nlsql.generator_from_environment({"SQL_GENERATOR": "command", "SQL_GENERATOR_COMMAND": "cat"})
    assert "Question: how many?" in made.generate("how many?", "t: a:V", nlsql.PROMPT)
    with pytest.raises(RuntimeError):
        nlsql.CommandGenerator(["false"]).generate("q", "s", "p")
    with pytest.raises(ValueError, match="unknown SQL_GENERATOR"):
        nlsql.generator_from_environment({"SQL_GENERATOR": "x"})
    assert semantic.CommandEmbedder(["sh", "-c", "cat > /dev/null; echo '[1, 0.5]'"]).embed("text") == [1.0, 0.5]


def test_formats_and_footers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a, "b"\nc', None), (2, "", "x")], "k int, text string, z string")
    catalog.write_csv(df, f"{tmp_path}/csv")
    back = catalog.read_external(spark, f"{tmp_path}/csv", "csv")
    assert sorted(map(tuple, back.collect())) == [("1", 'a, "b"\nc', None), ("2", "", "x")] or back.filter("k = 1").first().text == 'a, "b"\nc'
    assert [r.line for r in catalog.csv_rows(df).collect()] == ['1,"a, ""b""\nc",', "2,,x"] and catalog.csv_header(df) == "k,text,z"
    (tmp_path / "x.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "x.xml").write_text("<t><row><a>1</a></row><row><a>2</a></row></t>")
    assert [tuple(r) for r in catalog.read_external(spark, f"{tmp_path}/x.tsv", "tsv").collect()] == [("1", "2")]
    assert catalog.read_external(spark, f"{tmp_path}/x.xml", "xml").count() == 2
    with pytest.raises(ValueError, match="unknown format"):
        catalog.read_external(spark, "x", "xlsx")
    import pyarrow as pa
    import pyarrow.parquet as pq

    block = {"columns": [{"name": "a", "metadata": {"description": "the a"}}, {"name": "b", "metadata": None}]}
    table = pa.table({"a": [1], "b": [2]}).replace_schema_metadata({"pandas": json.dumps(block)})
    pq.write_table(table, f"{tmp_path}/noted.parquet")
    got = {r.name: r.description for r in catalog.registry(spark, {"d.noted": f"{tmp_path}/noted.parquet"}).collect()}
    assert got == {"a": "the a", "b": None} and catalog.footer_descriptions({"pandas": "no json"}) == {}


def test_sessions_can_be_limited():
    from govlake import session

    made = {}

    class Builder:
        def __getattr__(self, name):
            return lambda *a: made.update({name if len(a) < 2 else a[0]: a[-1]}) or self if a else made

    class Fake:
        builder = Builder()

    real, session.SparkSession = session.SparkSession, Fake
    try:
        session.build_session("x", threads=4, memory="6g")
    finally:
        session.SparkSession = real
    assert made["master"] == "local[4]" and made["spark.driver.memory"] == "6g"


def test_failure_words():
    assert [ingest.classify_text(m) for m in ("Type NOT SUPPORTED", "user not authorized", "table does not exist", "404 Not found", "incompatible", "permission", "timeout")] == ["INCOMPATIBLE", "ACCESS_DENIED", "ACCESS_DENIED", "ACCESS_DENIED", "RETRY", "RETRY", "RETRY"]


def test_console_keys():
    from govlake.plans.console import QUIT, Console

    asked = []
    con = Console(asked.append)
    press = lambda *keys: [con.press(k) for k in keys][-1]
    press("h", "i", "x", "backspace", " ", "enter")
    assert asked == ["hi"] and con.busy and con.text == ""
    press("a", "enter", "up")  # not heard while busy
    assert asked == ["hi"] and con.text == "" and press("q") is None and press("ctrl+c") == QUIT
    con.show(nlsql.State.DONE, rows=3)
    press("down", "down", "down", "wheelup")
    assert con.row == 1 and press("up", "up") is None and con.row == 0
    press("ctrl+l", "y", "o", "enter")
    con.show(nlsql.State.ERROR)
    press("up")
    assert con.text == "yo"
    press("up", "up")
    assert con.text == "hi"
    press("down", "down", "down")
    assert con.text == "" and press("q") == QUIT
    con.paste("q")
    assert press("q") is None and con.text == "qq"
    press("ctrl+m")
    assert not con.mouse
