"""The library without its training-data operators."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import contract, health, inventory, security, timeseries
from tidemark.plans import flows, planner, tasks
from tidemark.plans.versioned import Conflict, VersionedTable
from tidemark.session import scratch
from tidemark.sources import metadata, tables
from tidemark.streaming import ingest

ORDER = "id string, tenant_id string, shared_with array<string>"


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([("1", "a", []), ("2", "b", ["a"]), ("3", "b", ["c"]), ("4", "", [])], ORDER)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_flow_is_repeatable(spark):
    assert [o.rows[0].row_count for o in (flows.ingest(spark, "flow_a")[-1], flows.ingest(spark, "flow_a")[-1])] == [3, 6]
    assert [r.table_name for r in tables.list_tables(spark, "flow_a").collect()] == ["events"]
    assert spark.table("flow_a.events").schema == tables.EVENTS


def test_flow_stops_at_the_first_error_and_cleans_up(spark):
    ran = []

    def fail(*_):
        raise ValueError("no")

    steps = [tasks.Task("a", lambda *_: ran.append("a")), tasks.Task("b", fail, cleanup=lambda _: ran.append("clean")), tasks.Task("c", lambda *_: ran.append("c"))]
    with pytest.raises(tasks.TaskFailed) as e:
        tasks.run_flow(spark, steps)
    assert ran == ["a", "clean"] and [o.status for o in e.value.outcomes] == ["success", "failed"]


def test_row_security(spark, orders):
    assert ids(security.visible_to(orders, "a")) == ["1", "2"]
    assert ids(security.visible_to(orders, None)) == [] and ids(security.visible_to(orders, "x")) == []
    security.set_tenant(spark, None)
    assert security.visible_in_session(orders).count() == 0
    security.set_tenant(spark, "c")
    assert ids(security.visible_in_session(orders)) == ["3"]
    with pytest.raises(Exception, match="violates"):
        security.checked_for(orders, "a").collect()


def test_policies(spark, orders):
    orders.write.saveAsTable("policed")
    security.create_policy("policed")
    with pytest.raises(ValueError):
        security.create_policy("policed")
    assert ids(security.read_as(spark, "policed", "b")) == ["2", "3"]


def test_prefix_keeps_the_slash(spark):
    keys = spark.createDataFrame([("tenant-a/x",), ("tenant-ab/x",)], "key string")
    assert ids(keys.where(security.under_prefix(F.col("key"), "tenant-a"))) == ["tenant-a/x"]


def test_tenant_schema(spark):
    assert tables.create_tenant_schema(spark, "tenant-a") == "tenant_tenant_a"
    with pytest.raises(ValueError):
        tables.tenant_schema("a; drop")


def test_defaults(spark):
    row = tables.with_defaults(spark.createDataFrame([("t", "{}")], "tenant_id string, payload string")).first()
    assert len(row.id) == 36 and row.shared_with == [] and row.created_at is not None


def test_json_and_garbage(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(['{"a":1}', "", None, "{", '{"a":1}}', "1"])], "i int, t string")
    assert [r.i for r in rows.where(contract.is_json(F.col("t"))).collect()] == [0, 5]
    values = spark.createDataFrame([(1, {"a": "ok", "b": "", "c": "x\x1b[0m", "d": "No outputs found", "e": "WARNING: x", "f": None})], "doc_id int, outputs map<string, string>")
    assert sorted(r.name for r in contract.garbage_keys(values).collect()) == ["b", "c", "d", "e"]
    assert [r.name for r in contract.missing_keys(values, ["a", "z", "y"]).orderBy("place").collect()] == ["z", "y"]
    with pytest.raises(Exception, match="not allowed"):
        rows.select(contract.one_of(F.col("t"), ["1"])).collect()


def test_drift(spark):
    kind = "path string, bytes long"
    catalog, stored = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], kind), spark.createDataFrame([("a", 1), ("b", 9), ("d", 4)], kind)
    found = {r.path: r.status for r in inventory.drift(catalog, stored).collect()}
    assert found == {"a": "ok", "b": "size_mismatch", "c": "missing", "d": "orphan"}
    assert inventory.drift(catalog.limit(0), stored.limit(0)).count() == 0


def test_prefix_is_encoded_once(spark):
    config = metadata.catalog_config(spark.createDataFrame([("tenant-a",)], "name string"))
    assert metadata.default_prefix(config).first().prefix == "main%7Ctenant-a"


def test_objects(spark, tmp_path):
    (tmp_path / "tenant-a").mkdir()
    (tmp_path / "tenant-ab").mkdir()
    (tmp_path / "tenant-a" / "x.bin").write_bytes(b"123")
    (tmp_path / "tenant-ab" / "y.bin").write_bytes(b"1")
    assert [(r.key, r.bytes) for r in metadata.objects(spark, str(tmp_path), "tenant-a/").collect()] == [("tenant-a/x.bin", 3)]
    assert metadata.stat(spark, str(tmp_path), "tenant-a/none").count() == 0


def series(spark, *rows):
    return spark.createDataFrame([("c", {"pod": p}, p, dt.datetime(2024, 1, 1, 0, m), float(v)) for p, m, v in rows], "metric string, labels map<string, string>, pod string, ts timestamp_ntz, value double")


def test_increase_knows_resets_and_ranges(spark):
    s = series(spark, ("a", 0, 100), ("a", 6, 110), ("a", 8, 5), ("a", 10, 7), ("b", 9, 3))
    found = {r.pod: r.increase for r in timeseries.increase(s, ["pod"], "2024-01-01 00:10:00", 300).collect()}
    assert found == {"a": 7.0}  # 110 → 5 is a reset (5), then 2; what was before the range doesn't count; b has one sample
    assert timeseries.selected(s, "c", pod="b").count() == 1
    gauges = {r.pod: r.value for r in timeseries.gauge_sum_by(s, ["pod"], "pod", "2024-01-01 00:10:00", 300).collect()}
    assert gauges == {"a": 7.0, "b": 3.0}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.joined_lines(F.array(F.lit("a"), F.lit(""), F.lit(None), F.lit("b"))).alias("x"),
        scalars.exit_code(F.expr("array(named_struct('name', 'm', 'state', named_struct('terminated', named_struct('exitCode', 3))))"), "m").alias("y"),
        scalars.exit_code(F.expr("array(named_struct('name', 'm', 'state', named_struct('terminated', named_struct('exitCode', 3))))"), "n").alias("z"),
    ).first()
    assert (row.x, row.y, row.z) == ("a\nb", 3, -1)


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "day")
    t.append_fragmented(spark.range(200).select("id", (F.col("id") % 4).cast("string").alias("day")), 4)
    return t


def test_compaction_changes_files_not_rows(table):
    before, first = {r.partition: r for r in table.health().collect()}, table.head()
    plain = {r.path for r in table.files(first).where("partition = '3'").collect()}
    dry = table.plan(n=2).select("partition").distinct().count()
    done = table.compact(n=2)
    after = {r.partition: r for r in table.health().collect()}
    assert dry == done["partitions"] == 2
    assert sum(after[k].file_count < before[k].file_count for k in before) == 2
    assert all(after[k].row_count == before[k].row_count for k in before)
    assert plain == {r.path for r in table.files(table.head()).where("partition = '3'").collect()}
    assert inventory.same_rows(table.read(snapshot=first), table.read())


def test_writers_conflict(table, spark):
    base = table.branch("work")
    table.append(spark.range(1).select("id", F.lit("9").alias("day")))
    with pytest.raises(Conflict):
        table.move("main", base, base)
    assert table.read("work").count() == 200 and table.read().count() == 201


def test_garbage_respects_all_branches(table):
    table.branch("kept")
    table.compact(n=4)
    assert table.collect_garbage(0) == 0 and table.read("kept").count() == 200
    assert table.garbage(3600).count() == 0
    table.drop_branch("kept")
    assert table.collect_garbage(0) > 0 and table.read().count() == 200


def test_log_rewrite_keeps_files(table):
    before = sorted(r.path for r in table.files(table.head()).collect())
    table.rewrite_log()
    assert before == sorted(r.path for r in table.files(table.head()).collect())


def test_empty_commit_has_no_data(table, spark):
    t = VersionedTable(spark, table.root + "-empty")
    t.commit(t.files(None), "main", None, "append")
    assert t.snapshots().first().summary["manifests-created"] == "0"


def test_planner(table, spark, tmp_path):
    audit = f"file://{tmp_path}/audit"
    assert planner.run(table, "t", audit, dry=True)["files_planned"] > 0
    assert planner.run(table, "t", audit)["files_rewritten"] > 0
    assert sorted(r.operation for r in spark.read.parquet(audit).collect()) == ["compact", "dry-run"]
    with planner.only_one(spark, table.root), pytest.raises(Exception):
        with planner.only_one(spark, table.root):
            pass
    documents = [
        ('{"nodes":{"m.a":{"name":"a","schema":"s","meta":{"compaction":true}},"m.b":{"name":"b","schema":"s","meta":{}}}}',),
        ('{"results":[{"unique_id":"m.a","status":"success"},{"unique_id":"m.b","status":"success"}]}',),
    ]
    manifest, results = (spark.createDataFrame([d], "document string") for d in documents)
    files = spark.createDataFrame([(t, p, f"{p}{i}", 1, 10) for t in ("s.a", "s.b") for p in "xy" for i in range(4)], "table string, partition string, path string, rows long, bytes long")
    rows = files.groupBy("table", "partition").agg(F.count("*").alias("file_count"), F.sum("bytes").alias("bytes"))
    found = planner.plan(manifest, results, rows).collect()
    assert sorted((r.table, r.partition) for r in found) == [("s.a", "x"), ("s.a", "y")]
    assert planner.plan(manifest, results, rows, spark.createDataFrame([("s.b",)], "table string")).count() == 0


def test_health_of_nothing(spark):
    files = spark.createDataFrame([], "partition string, path string, rows long, bytes long")
    assert health.scored(health.health(files)).count() == 0


def test_stream(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in "stp")
    rows = spark.range(10).select("id", F.lit("x").alias("event_type"), F.timestamp_seconds("id").alias("ts"), F.lit(1.0).alias("value"))
    rows.write.parquet(source)
    assert (ingest.ingest(spark, source, target, progress, rows.schema), ingest.ingest(spark, source, target, progress, rows.schema)) == (10, 0)
    assert spark.read.parquet(target).count() == 10


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    from tidemark import queries as q

    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    for name in ("events_count", "rls_visible", "table_health", "drift", "contract_missing", "json_valid", "counter_increase", "scalar_functions"):
        df = q.QUERIES[name](spark, d)
        columns = sorted(df.columns)
        text = lambda v: str(round(v, 4)) if isinstance(v, float) else str(v)
        mine = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
        cursor = con.execute(q.SQL[name])
        names = [x[0] for x in cursor.description]
        theirs = sorted(tuple(text(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())
        assert mine == theirs, name


def test_checked_rows_fail_whatever_is_read_of_them(spark, orders, tmp_path):
    checked = security.checked_for(orders, "a")
    for act in (lambda: checked.select("tenant_id").collect(), checked.count, lambda: checked.write.parquet(f"{tmp_path}/checked")):
        with pytest.raises(Exception, match="violates"):
            act()
    own = orders.where("tenant_id = 'a'")
    assert security.checked_for(own, "a").count() == own.count() > 0


def test_an_unknown_policy_shows_nothing(spark, orders):
    orders.write.saveAsTable("guarded")
    assert security.read_as(spark, "guarded", "a").count() == orders.count()
    security.create_policy("guarded", security.owner_or_shared)
    assert security.policy_of(spark, "guarded") == "owner_or_shared"
    spark.sql(f"ALTER TABLE guarded SET TBLPROPERTIES ('{security.PROPERTY}' = 'of another session')")
    assert security.read_as(spark, "guarded", "a").count() == 0


def test_json_that_closes_what_is_around_it(spark):
    texts = ['"a"],["b"', '1},{"x":2', '1,"end":true}', "1,null", "1]", '{"v":1},"end":true', " [1, 2] ", "null", '{"a": {"b": []}}', "{}{}", "[1][2]", '"]"', '"}"']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", contract.is_json(F.col("t")).alias("ok")).collect()
    assert [texts[r.i] for r in rows if r.ok] == [" [1, 2] ", "null", '{"a": {"b": []}}', '"]"', '"}"']


def test_a_commit_between_look_and_move_is_not_lost(table, spark, monkeypatch):
    """Another writer commits after the first has looked at the branch's number."""
    base, number = table.head(), VersionedTable._number
    other = VersionedTable(spark, table.root, "day")
    done = []

    def late(self, branch):
        found = number(self, branch)
        if self is table and branch == "main" and not done:
            done.append(1)
            other.append(spark.range(5).select("id", F.lit("7").alias("day")))
        return found

    monkeypatch.setattr(VersionedTable, "_number", late)
    with pytest.raises(Conflict):
        table.move("main", base, base)
    assert done and table.read().count() == 205


def test_nothing_is_garbage_without_branches(table):
    table.drop_branch("main")
    with pytest.raises(RuntimeError, match="no branch"):
        table.garbage(0)


def test_a_task_over_its_time_is_stopped(spark):
    import time

    began = time.monotonic()
    with pytest.raises(tasks.TaskFailed, match="TimeoutError"):
        tasks.run_flow(spark, [tasks.Task("slow", lambda s, _: s.range(1 << 40).selectExpr("sum(hash(id))").collect(), seconds=1)])
    assert time.monotonic() - began < 30
    assert spark.range(10).count() == 10


def test_rates_of_a_range_are_those_of_its_instants(spark):
    rows = [("cpu", {"pod": "a"}, f"2024-01-01 00:{m:02d}:{s:02d}", float(v)) for m, s, v in [(0, 0, 1), (0, 30, 4), (1, 0, 2), (1, 0, 2), (4, 0, 9), (4, 59, 3), (9, 0, 5)]]
    rows += [("cpu", {"pod": "b"}, "2024-01-01 00:02:00", 7.0)]
    made = spark.createDataFrame(rows, "metric string, labels map<string, string>, ts string, value double")
    made = made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("pod", F.col("labels")["pod"])
    found = {(r.pod, str(r.tick)): r.rate for r in timeseries.rate_range(made, ["pod"], "2024-01-01 00:00:30", "2024-01-01 00:10:30", 60, 180).collect()}
    want = {}
    for m in range(11):
        tick = f"2024-01-01 00:{m:02d}:30"
        want |= {(r.pod, tick): r.rate for r in timeseries.rate(made, ["pod"], tick, 180).collect()}
    assert found == pytest.approx(want) and len(want) > 5
    assert timeseries.rate_range(made.limit(0), ["pod"], "2024-01-01 00:00:00", "2024-01-01 01:00:00", 60, 180).count() == 0


def test_advice_rewrites_what_the_plan_names(spark, table, tmp_path):
    other = VersionedTable(spark, f"file://{tmp_path}/other", "day")
    other.append_fragmented(spark.range(40).select("id", F.lit("0").alias("day")), 4)
    lake = {"s.a": table, "s.b": other}
    manifest = spark.createDataFrame([('{"nodes":{"m.a":{"name":"a","schema":"s","meta":{"compaction":true}},"m.b":{"name":"b","schema":"s","meta":{"compaction":true}}}}',)], "document string")
    results = spark.createDataFrame([('{"results":[{"unique_id":"m.a","status":"success"},{"unique_id":"m.b","status":"error"}]}',)], "document string")
    audit, head = f"file://{tmp_path}/audit", other.head()
    preset = planner.Preset(partitions=2)
    assert planner.advise(lake, manifest, results, audit, preset=preset, dry=True)["s.a"]["files_planned"] > 0
    before = {r.partition: r.file_count for r in table.health().collect()}
    assert list(planner.advise(lake, manifest, results, audit, preset=preset)) == ["s.a"]
    after = {r.partition: r.file_count for r in table.health().collect()}
    assert sum(after[k] < before[k] for k in before) == 2 and table.read().count() == 200
    assert other.head() == head and planner.advise({}, manifest, results, audit) == {}
    quota = planner.Preset(quota_bytes=0)
    assert planner.advise({"s.a": table}, manifest, results, audit, preset=quota) == {}


def test_a_cluster_must_name_its_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://a:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        scratch(Fake, "x")


def test_same_rows_counts_repeated_rows(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "a string, `b.c` double")
    one, nan = ("x", 1.0), (None, float("nan"))
    assert inventory.same_rows(rows(one, one, nan), rows(nan, one, one))
    assert inventory.same_rows(rows(one), rows(one).select("`b.c`", "a"))
    assert not inventory.same_rows(rows(one, one, nan), rows(one, nan, nan))
    assert not inventory.same_rows(rows(one), rows(one).withColumnRenamed("a", "d"))
    assert inventory.same_rows(rows(), rows()) and not inventory.same_rows(rows(), rows(one))
