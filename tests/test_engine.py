"""What the catalogue cannot show: errors, semantics that differ from Spark's defaults, plans, sources, settings and the service."""

import functools
import http.server
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom import config, service, sources, types
from sparkloom import functions as X
from sparkloom import operators as O
from sparkloom.plans import catalogue
from sparkloom.streaming import read_folder, windowed

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 2.5, True), (2, None, 3.5, None), (3, "bob", None, False)], "id int, name string, pay double, ok boolean")


def test_rounding_and_casts(spark, people):
    assert [r[0] for r in people.select(X.rounded(people, F.col("pay"))).collect()] == [2.0, 4.0, None]
    with pytest.raises(Exception, match="fraction"):
        people.select(X.safe_cast(people, F.col("pay"), "int64")).collect()
    with pytest.raises(Exception):
        people.select(X.safe_cast(people, F.col("name"), "int32")).collect()
    small = spark.createDataFrame([(7, 2)], "a smallint, b int")
    assert O.project(small, X.arithmetic(small, F.col("a"), "/", F.col("b"))).dtypes == [("col_0", "int")]
    with pytest.raises(TypeError):
        X.upper(people, F.col("pay"))
    with pytest.raises(TypeError):
        X.compare(people, F.col("id"), "=", F.col("pay"), strict_types=True)


def test_null_logic(people):
    null, true = F.lit(None).cast("boolean"), F.lit(True)
    row = people.limit(1).select((null | true).alias("a"), X.strict_or(null, true).alias("b"), X.strict_and(null, F.lit(False)).alias("c")).first()
    assert tuple(row) == (True, None, None)
    assert O.where(people, F.col("ok")).count() == 1


def test_operator_errors(people):
    for bad in (lambda: O.prune(people), lambda: O.prune(people, "zz"), lambda: O.limit(people, -1), lambda: O.distinct_on(people, []), lambda: O.JoinClause(("a",), ()), lambda: O.sort(people), lambda: O.join(people, people, O.JoinClause(("id",), ("id",)), "full")):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: O.where(people, F.col("id")), lambda: O.aggregate(people, O.Agg("sum", "name")), lambda: O.having(people, F.col("pay"))):
        with pytest.raises(TypeError):
            bad()


def test_names(people):
    got = O.group_by(people, ["ok"], O.Agg("sum", "pay"), O.Agg("count", "*", "n"))
    assert got.columns == ["group_Column(ok)", "sum_Column(pay)", "n"] and got.count() == 3
    joined = O.join(people, people, O.JoinClause(("id",), ("id",)), residual=lambda left, right: left("pay") == right("pay"))
    assert joined.columns[:2] == ["left_id", "left_name"] and joined.count() == 2
    odd = people.withColumnRenamed("pay", "pay (h).x")
    assert O.project(odd, "pay (h).x").columns == ["pay (h).x"]


def test_sort_defaults(people):
    assert [r.id for r in O.sort(people, O.sort_key("pay")).collect()] == [2, 1, 3]
    assert [r.id for r in O.sort(people, O.sort_key("pay", asc=True)).collect()] == [3, 1, 2]


def test_plans(spark):
    lineitem = sources.parquet(spark, f"{DATA}/lineitem.parquet")
    plan = O.project(O.where(lineitem, F.col("l_quantity") > 40), "l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "l_comment" not in plan
    assert "TakeOrderedAndProject" in O.top_k(lineitem, 3, O.sort_key("l_quantity"))._jdf.queryExecution().executedPlan().toString()


def test_join_count_makes_no_pairs(spark):
    query = catalogue.queries()["join_many"](spark, DATA)
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join") :].count("Aggregate") == 2  # both sides are counted below the join
    one = spark.range(3_000_000).select(F.lit(1).alias("k"))
    assert [tuple(r) for r in O.join_count(one, one, O.JoinClause(("k",), ("k",)), [F.col("left_k").alias("k")], "n").collect()] == [(1, 9e12)]
    a = spark.range(120).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("v"))
    b = spark.range(90).select(F.when(F.col("id") % 5 > 1, (F.col("id") % 5).cast("string")).alias("s"), (F.col("id") % 4).alias("v"))
    clause = O.JoinClause(("k",), (F.col("s").cast("int") * 2,))
    for how in ("inner", "left", "right"):
        for residual in (None, lambda left, right: left("v") < right("v")):
            for keys in (["k"], ["s", (F.col("left_v") + 1).alias("w")], [F.lit(0).alias("all")]):
                wanted = O.group_by(O.join(a, b, clause, how, residual), keys, O.Agg("count", "*"))
                got = O.join_count(a, b, clause, keys, how=how, residual=residual)
                assert got.dtypes == wanted.dtypes
                assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    with pytest.raises(ValueError):
        O.join_count(a, b, clause, [])


def test_csv_types(spark, tmp_path):
    cases = {"": "string", " null ": "string", "true": "boolean", "TRUE": "string", "42": "bigint", " 42": "bigint", "1.5": "double", "1e3": "double", "x": "string"}
    assert {k: sources.sniff(k).simpleString() for k in cases} == cases
    path = tmp_path / "a.csv"
    path.write_text('a,b,c(h)\n1,true,x\nbad,yes,NULL\n,NULL,""\n')
    assert [tuple(r) for r in sources.csv(spark, str(path)).collect()] == [(1, True, "x"), (None, False, None), (None, None, None)]
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        sources.csv(spark, str(tmp_path / "empty.csv"))


def test_memory_and_addresses(spark):
    got = sources.memory(spark, ["u", "f"], [pa.array([255], pa.uint8()), pa.array([1.5], pa.float32())])
    assert got.dtypes == [("u", "smallint"), ("f", "float")]
    for names, columns in ((["a"], []), (["a", "b"], [[1], [1, 2]])):
        with pytest.raises(ValueError):
            sources.memory(spark, names, columns)
    assert sources.resolve("s3://b/k.parquet") == "s3a://b/k.parquet"
    for bad in ("", "foo://x", "a.xlsx", "a.bin"):
        with pytest.raises(ValueError):
            sources.open_source(spark, bad)
    assert types.from_name("uint64").simpleString() == "decimal(20,0)" and types.from_name("array<int>").simpleString() == "array<int>"
    with pytest.raises(ValueError):
        types.from_name("no such type")


def test_http_and_object_store_sources(spark, tmp_path):
    folder = tmp_path / "served"
    folder.mkdir()
    (folder / "a.csv").write_text("n,s\n1,x\n2,y\n")
    (folder / "b.txt").write_text("one\ntwo\n")
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(folder)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        assert [tuple(r) for r in sources.open_source(spark, f"{at}/a.csv").orderBy("n").collect()] == [(1, "x"), (2, "y")]
        assert sorted(r.value for r in sources.open_source(spark, f"{at}/b.txt").collect()) == ["one", "two"]
        small = config.merge(config.Config(), {"batch": {"max_download_size_mb": 0.000001}})
        with pytest.raises(ValueError, match="larger"):
            sources.open_source(spark, f"{at}/a.csv", config=small)
        with pytest.raises(OSError):
            sources.open_source(spark, f"{at}/none.csv")
    finally:
        server.shutdown()
    # a mounted file system stands in for an object store: only Spark's readers can open it
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.bucket.link./in", f"file://{folder}")
    assert sources.open_source(spark, "viewfs://bucket/in/b.txt", "text/plain").count() == 2
    load = config.merge(config.Config(), {"batch": {"should_download": True}})
    assert sources.open_source(spark, "viewfs://bucket/in/a.csv", config=load).count() == 2
    with pytest.raises(ValueError, match="larger"):
        sources.open_source(spark, "viewfs://bucket/in/a.csv", config=config.merge(config.Config(), {"batch": {"should_download": True, "max_download_size_mb": 0.000001}}))


def test_ranks_without_one_window(spark):
    rows = spark.range(10_000).select(((F.col("id") * 7919) % 10_000).alias("v"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("g"))
    got = O.ranked(rows, "rk", O.sort_key("g", asc=True), F.col("v"))
    wanted = sorted(rows.collect(), key=lambda r: (r.g is not None, r.g or 0, r.v))
    assert [tuple(r) for r in got.collect()] == [(r.v, r.g, n) for n, r in enumerate(wanted, 1)]
    assert O.ranked(rows.limit(0), "rk", F.col("v")).count() == 0
    assert [r.v for r in O.top_k(rows, O.HEAP_ROWS + 1, O.sort_key("v")).limit(3).collect()] == [9999, 9998, 9997]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_limits_of_requests(spark):
    slow = config.merge(config.Config(), {"server": {"timeout": 1}})
    ask = lambda sql, c: service.Service(spark, c).execute(service.QueryRequest(sql, service.Source(f"{DATA}/nation.parquet")))
    names = "abcdef"  # some seconds in one task, whether or not it notices that it was cancelled
    found = ask(f"SELECT a.n_name FROM {', '.join(f'data {x}' for x in names)} WHERE hash({', '.join(f'{x}.n_nationkey' for x in names)}) = 1", slow)
    assert found.code is service.Code.EXECUTION_ERROR and "more than 1 s" in found.error
    tight = config.merge(config.Config(), {"server": {"max_request_size_mb": 0.00001}})
    assert ask("SELECT 1", tight).code is service.Code.SUCCESS and ask("SELECT 1 AS a_long_name", tight).code is service.Code.PARSE_ERROR
    with pytest.raises(service.BadRequest) as e:
        service.run_query(spark, "SELECT 1 AS a_long_name", uri="x.csv", config=tight)
    assert e.value.status == 413


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("server:\n  port: 0\n  hostName: x\nbatch:\n  size: big\n")
    with pytest.warns(UserWarning):
        found = config.load(str(path))
    assert found.server.port == 0 and found.batch.size == 8192
    with pytest.raises(ValueError):
        config.load("s.toml")


def test_service(spark, tmp_path):
    with pytest.raises(service.BadRequest) as e:
        service.run_query(spark, "", uri="x")
    assert e.value.status == 422
    for file, uri in ((None, " "), ("a", "b")):
        with pytest.raises(service.BadRequest) as e:
            service.run_query(spark, "SELECT 1", file, uri)
        assert e.value.status == 400
    run = lambda sql, uri=f"{DATA}/nation.parquet", sink=None: service.Service(spark).execute(service.QueryRequest(sql, service.Source(uri), sink=sink))
    assert run("SELECT * FROM data").rows == 25
    codes = [run("SELEC"), run("SELECT zz FROM data"), run("SELECT 1", "/no/such.parquet"), run("SELECT assert_true(n_nationkey < 0) AS x FROM data WHERE raise_error('x') IS NULL"), run("")]
    assert [c.code.name for c in codes] == ["PARSE_ERROR", "PARSE_ERROR", "SOURCE_ERROR", "EXECUTION_ERROR", "PARSE_ERROR"]
    done = run("SELECT n_name FROM data", sink=str(tmp_path / "out"))
    assert done.code is service.Code.SUCCESS and spark.read.parquet(done.link).count() == 25
    assert run("SELECT 1", sink=str(tmp_path / "out")).code is service.Code.UPLOAD_ERROR
    assert service.health() == {"status": "healthy", "version": "0.1.0"}


def test_stream_windows(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 2.0), ("2024-01-01 00:10:00", "b", 5.0)], "ts string, kind string, v double").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed(read_folder(spark, str(tmp_path / "in"), events.schema), "ts", "1 minute", "1 minute", ["kind"], O.Agg("sum", "v", "total"))
    run = stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert ("a", 3.0) in [(r.kind, r.total) for r in spark.sql("SELECT * FROM windows").collect()]
