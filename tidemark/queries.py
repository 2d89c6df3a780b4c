"""The registered queries of the library, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars
from tidemark.operators import contract, health, inventory, security, timeseries
from tidemark.plans import flows, planner
from tidemark.plans.versioned import VersionedTable
from tidemark.session import scratch
from tidemark.sources import metadata, tables
from tidemark.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Tables, rows and counts.

VALUES = """(VALUES ('evt-001', 'signup', TIMESTAMP '2026-09-01 10:00:00', '{"plan":"free"}'),
('evt-002', 'signup', TIMESTAMP '2026-09-01 10:05:00', '{"plan":"pro"}'),
('evt-003', 'page_view', TIMESTAMP '2026-09-01 10:06:12', '{"path":"/pricing"}')) v(event_id, event_type, occurred_at, payload)"""


@query(f"SELECT event_id, event_type, occurred_at, payload FROM {VALUES}")
def literal_rows(spark, sf_dir):
    return tables.literal_rows(spark, flows.ROWS, tables.EVENTS)


@query(f"SELECT count(*) AS row_count FROM {VALUES}")
def ingest_flow(spark, sf_dir):
    """The whole flow on a schema of its own, which goes afterwards."""
    schema = "ingest_" + scratch(spark, "x").rsplit("-", 1)[1]
    try:
        outcomes = flows.ingest(spark, schema)
        listed = [r.table_name for r in tables.list_tables(spark, schema).collect()]
    finally:
        spark.sql(f"DROP SCHEMA IF EXISTS {schema} CASCADE")
    if listed != ["events"]:
        raise ValueError(listed)
    return spark.createDataFrame(outcomes[-1].rows, "row_count long")


@query("SELECT count(*) AS row_count FROM events")
def events_count(spark, sf_dir):
    return tables.row_count(read(spark, sf_dir, "events"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, ts AS occurred_at, props AS payload FROM events")
def versioned_append(spark, sf_dir):
    """Events appended in two commits to a versioned table and read back."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("ts").alias("occurred_at"), F.col("props").alias("payload"))
    table = VersionedTable(spark, scratch(spark, "append"))
    even = F.col("event_id").cast("long") % 2 == 0
    table.append(rows.where(even))
    table.append(rows.where(~even))
    return table.read()


# Row security.

ORDERS = """o AS (SELECT o_orderkey, 'tenant-' || (o_custkey % 5) AS tenant_id,
  CASE WHEN o_orderkey % 7 = 0 THEN ['tenant-' || ((o_custkey + 1) % 5)] ELSE [] END AS shared_with, o_totalprice FROM orders)"""


def shared_orders(spark, sf_dir):
    tenant = lambda n: F.concat(F.lit("tenant-"), (n % 5).cast("string"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        tenant(F.col("o_custkey")).alias("tenant_id"),
        F.when(F.col("o_orderkey") % 7 == 0, F.array(tenant(F.col("o_custkey") + 1))).otherwise(F.array().cast("array<string>")).alias("shared_with"),
        "o_totalprice",
    )


@query(f"WITH {ORDERS} SELECT o_orderkey, tenant_id, o_totalprice FROM o WHERE tenant_id = 'tenant-2' OR list_contains(shared_with, 'tenant-2')")
def rls_visible(spark, sf_dir):
    return security.visible_to(shared_orders(spark, sf_dir), "tenant-2").select("o_orderkey", "tenant_id", "o_totalprice")


@query(f"WITH {ORDERS} SELECT o_orderkey, tenant_id, o_totalprice FROM o WHERE false")
def rls_no_tenant(spark, sf_dir):
    return security.visible_to(shared_orders(spark, sf_dir), None).select("o_orderkey", "tenant_id", "o_totalprice")


@query(f"WITH {ORDERS} SELECT tenant_id, count(*) AS n FROM o WHERE tenant_id = 'tenant-3' OR list_contains(shared_with, 'tenant-3') GROUP BY tenant_id")
def rls_session(spark, sf_dir):
    security.set_tenant(spark, "tenant-3")
    return security.visible_in_session(shared_orders(spark, sf_dir)).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query(f"WITH {ORDERS} SELECT o_orderkey, tenant_id FROM o WHERE tenant_id = 'tenant-1'")
def rls_checked_write(spark, sf_dir):
    rows = shared_orders(spark, sf_dir).where("tenant_id = 'tenant-1'")
    return security.checked_for(rows, "tenant-1").select("o_orderkey", "tenant_id")


@query(f"""WITH {ORDERS} SELECT tenant_id, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 1) AS made_ids, CAST(sum(len(shared_with)) AS BIGINT) AS shares, count(*) AS timed
  FROM o WHERE tenant_id = 'tenant-2' OR list_contains(shared_with, 'tenant-2') GROUP BY tenant_id""")
def tenant_table(spark, sf_dir):
    """A table with a policy in a tenant's own schema: rows appended without ids, shares and times get them, and are read as
    a tenant. The schema goes afterwards. (S9, S10, S10a, X3)"""
    schema = tables.create_tenant_schema(spark, "t-" + scratch(spark, "x").rsplit("-", 1)[1])
    try:
        tables.create_table(spark, schema, "shared_orders", tables.SHARED_ORDERS)
        given = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string"))
        shared = F.when(F.size("shared_with") > 0, F.col("shared_with"))
        rows = shared_orders(spark, sf_dir).select(given.alias("id"), "tenant_id", shared.alias("shared_with"), F.col("o_totalprice").cast("string").alias("payload"))
        tables.append(tables.with_defaults(rows), schema, "shared_orders")
        name = tables.quoted(schema, "shared_orders")
        security.create_policy(name)
        seen = security.read_as(spark, name, "tenant-2").groupBy("tenant_id").agg(
            F.count("*").alias("n"),
            F.count_distinct(F.when(F.length("id") == 36, F.col("id"))).alias("made_ids"),
            F.sum(F.size("shared_with")).cast("long").alias("shares"),
            F.count("created_at").alias("timed"),
        )
        return spark.createDataFrame(seen.collect(), seen.schema)
    finally:
        spark.sql(f"DROP SCHEMA IF EXISTS {tables.quoted(schema)} CASCADE")


@query("SELECT c_custkey, 'tenant-' || (c_custkey % 20) || '/part-' || c_custkey AS key FROM customer WHERE c_custkey % 20 = 1")
def prefix_scope(spark, sf_dir):
    key = F.concat(F.lit("tenant-"), (F.col("c_custkey") % 20).cast("string"), F.lit("/part-"), F.col("c_custkey").cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", key.alias("key")).where(security.under_prefix(F.col("key"), "tenant-1"))


# Files, health and plans.

EVENT_FILES = """f AS (SELECT strftime(ts, '%Y-%m-%d') AS "partition", 'f' || (event_id % 8) AS path, count(*) AS "rows", CAST(sum(length(props) + 40) AS BIGINT) AS bytes
  FROM events GROUP BY ALL)"""


def event_files(spark, sf_dir):
    by = [F.date_format("ts", "yyyy-MM-dd").alias("partition"), F.concat(F.lit("f"), (F.col("event_id") % 8).cast("string")).alias("path")]
    return read(spark, sf_dir, "events").groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.length("props") + F.lit(40)).alias("bytes"))


@query(f'WITH {EVENT_FILES} SELECT "partition", path, "rows", bytes FROM f')
def files_meta(spark, sf_dir):
    return event_files(spark, sf_dir)


HEALTH = f"""{EVENT_FILES}, h AS (SELECT "partition", count(*) AS file_count, CAST(sum("rows") AS BIGINT) AS row_count, CAST(sum(bytes) AS BIGINT) AS bytes,
  min(bytes) AS min_bytes, max(bytes) AS max_bytes, avg(bytes) AS avg_bytes, quantile_cont(bytes, 0.5) AS median_bytes FROM f GROUP BY "partition"),
  s AS (SELECT *, greatest(1, CAST(ceil(bytes / 4000.0) AS BIGINT)) AS ideal_files FROM h),
  e AS (SELECT *, greatest(0.0, 1 - ideal_files / CAST(file_count AS DOUBLE)) AS score FROM s)"""


@query(f'WITH {HEALTH} SELECT "partition", file_count, row_count, bytes, min_bytes, max_bytes, round(avg_bytes, 4) AS avg_bytes, round(median_bytes, 4) AS median_bytes FROM h')
def table_health(spark, sf_dir):
    return health.health(event_files(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("avg_bytes", "median_bytes")})


@query(f'WITH {HEALTH} SELECT "partition", ideal_files, round(score, 6) AS score, file_count >= 2 AND score >= 0.25 AS eligible FROM e')
def partition_score(spark, sf_dir):
    rows = health.scored(health.health(event_files(spark, sf_dir)), target=4000, threshold=0.25)
    return rows.select("partition", "ideal_files", F.round("score", 6).alias("score"), "eligible")


@query(f'WITH {HEALTH} SELECT "partition", round(score, 6) AS score FROM e WHERE file_count >= 2 AND score >= 0.1 ORDER BY e.score DESC, file_count DESC, "partition" LIMIT 5')
def worst_partitions(spark, sf_dir):
    rows = health.scored(health.health(event_files(spark, sf_dir)), target=4000, threshold=0.1)
    return health.worst(rows, 5).select("partition", F.round("score", 6).alias("score"))


@query(f"""WITH {EVENT_FILES} SELECT "partition", path, bytes,
  CAST(floor(coalesce(sum(bytes) OVER (PARTITION BY "partition" ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4000.0) AS BIGINT) AS bin FROM f""")
def bin_pack(spark, sf_dir):
    return health.bins(event_files(spark, sf_dir), 4000).select("partition", "path", "bytes", "bin")


@query("SELECT event_id, ts, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5)")
def topk_recent(spark, sf_dir):
    return health.latest(read(spark, sf_dir, "events").select("event_id", "ts", "event_type"), 5, "ts", "event_id")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE strftime(ts, '%Y-%m-%d') IN ('2024-01-03', '2024-01-07') GROUP BY 1")
def scoped_partitions(spark, sf_dir):
    """Rows of two partitions of a table that was fragmented on purpose; the scan lists these alone."""
    path = scratch(spark, "fragmented")
    metadata.fragment(read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), path, 4, "day")
    table = spark.read.schema("event_id long, day string").parquet(path)
    return health.only_partitions(table, "day", ["2024-01-03", "2024-01-07"]).groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT 'day=' || strftime(ts, '%Y-%m-%d') AS folder FROM events GROUP BY 1")
def object_folders(spark, sf_dir):
    """Folders that hold data files, from a listing of stored objects."""
    path = scratch(spark, "objects")
    metadata.fragment(read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), path, 2, "day")
    return metadata.objects(spark, path, "day=").select(F.substring_index("key", "/", 1).alias("folder")).distinct()


@query("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, count(DISTINCT c_mktsegment) AS segments FROM customer")
def staged_copy(spark, sf_dir):
    """Customers staged as CSV and copied into a table of a schema of its own, which is listed and goes afterwards."""
    rows, staged, schema = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), scratch(spark, "staged"), "staged_" + scratch(spark, "x").rsplit("-", 1)[1]
    rows.write.option("header", "true").csv(staged)
    tables.create_schema(spark, schema)
    try:
        tables.create_table(spark, schema, "customer", rows.schema)
        tables.copy_in(spark, staged, schema, "customer", "csv", header="true")
        if metadata.namespaces(spark).where(F.col("namespace") == schema).count() != 1:
            raise ValueError(schema)
        found = spark.table(tables.quoted(schema, "customer")).agg(F.count("*").alias("n"), F.sum("c_custkey").cast("long").alias("keys"), F.count_distinct("c_mktsegment").alias("segments"))
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        spark.sql(f"DROP SCHEMA IF EXISTS {tables.quoted(schema)} CASCADE")


@query("SELECT '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS tenants FROM nation")
def document_round_trip(spark, sf_dir):
    """A JSON document written and read again as a whole."""
    path = scratch(spark, "document")
    metadata.write_document(metadata.tenants(read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))).coalesce(1), path)
    return metadata.document(spark, path).select(F.get_json_object("document", "$.tenants").alias("tenants")).where("tenants IS NOT NULL")


@query("SELECT strftime(ts, '%Y-%m-%d') AS \"partition\", count(*) AS \"rows\" FROM events GROUP BY 1")
def physical_files(spark, sf_dir):
    """Rows by partition as file metadata of a written table tell."""
    path = scratch(spark, "files")
    metadata.fragment(read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), path, 4, "day")
    return metadata.files(spark, path, "day").groupBy("partition").agg(F.sum("rows").alias("rows"))


@query("SELECT CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS bytes, true AS same_size, CAST(0 AS BIGINT) AS absent FROM customer")
def object_sizes(spark, sf_dir):
    """The bytes of all objects that names were written to, one object's size looked up by its key, and a key that isn't there."""
    path = scratch(spark, "sizes")
    read(spark, sf_dir, "customer").select("c_name").write.text(path)
    found = metadata.objects(spark, path)
    first = found.orderBy("key").first()
    one, absent = metadata.stat(spark, path, first["key"]).first(), metadata.stat(spark, path, first["key"] + "x").count()
    return found.agg(F.sum("bytes").alias("bytes")).select("bytes", F.lit(one["bytes"] == first["bytes"]).alias("same_size"), F.lit(absent).cast("long").alias("absent"))


@query("SELECT event_type AS operation, count(*) AS n, count(*) AS logged FROM events GROUP BY event_type")
def audit_log(spark, sf_dir):
    """A log written in two appends."""
    rows, path = read(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), "event_id"), scratch(spark, "log")
    for part in (0, 1):
        tables.log(rows.where(F.col("event_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy("operation").agg(F.count("*").alias("n"), F.count("logged_at").alias("logged"))


@query("SELECT c_custkey, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def allow_list(spark, sf_dir):
    """Rows whose name is on an allow-list that holds each name twice."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), "n_regionkey")
    listed = nation.where("n_regionkey = 1").select("name")
    rows = read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "name")
    return health.allowed(rows, listed.unionByName(listed))


@query("SELECT event_type AS \"table\", count(*) AS runs, CAST(sum(event_id % 10) AS BIGINT) AS files, CAST(sum(event_id) AS BIGINT) AS bytes, round(sum(value), 6) AS seconds FROM events GROUP BY event_type")
def run_costs(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select(F.col("event_type").alias("table"), (F.col("event_id") % 10).alias("files"), F.col("event_id").alias("bytes"), F.col("value").alias("seconds"))
    return health.costs(runs)


# Maintenance that rewrites files.


def fragmented(spark, sf_dir) -> VersionedTable:
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    table = VersionedTable(spark, scratch(spark, "versioned"), "day")
    table.append_fragmented(rows, 4)
    return table


DAYS = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1"


@query(DAYS)
def compact_table(spark, sf_dir):
    """Rows by day after the three most fragmented days were compacted."""
    table = fragmented(spark, sf_dir)
    table.compact(n=3)
    return table.read().groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("""SELECT CAST(least(3, count(DISTINCT strftime(ts, '%Y-%m-%d'))) AS INTEGER) AS compacted, count(*) AS rows_kept, count(*) AS rows_after,
  true AS fewer_files, true AS same_rows, true AS collected FROM events""")
def compact_effects(spark, sf_dir):
    """What a compaction of three days and a collection of unreachable files change."""
    table = fragmented(spark, sf_dir)
    before = {r.partition: r.file_count for r in table.health().collect()}
    first = table.head()
    table.branch("kept")
    table.compact(n=3)
    after = {r.partition: r.file_count for r in table.health().collect()}
    same = inventory.same_rows(table.read(snapshot=first), table.read())
    table.collect_garbage(0)
    kept = table.read("kept").count()
    table.drop_branch("kept")
    gone = table.collect_garbage(0)
    changed = sum(after[k] < before[k] for k in before)
    row = (changed, kept, table.read().count(), sum(after.values()) < sum(before.values()), same, gone > 0)
    return spark.createDataFrame([row], "compacted int, rows_kept long, rows_after long, fewer_files boolean, same_rows boolean, collected boolean")


@query("""SELECT 'lake.events' AS "table", count(DISTINCT strftime(ts, '%Y-%m-%d')) AS partitions, count(*) AS "rows" FROM events
  UNION ALL SELECT 'lake.prices', 0, count(*) FROM events""")
def advised_compaction(spark, sf_dir):
    """The loop from the last run to compacted tables: two tables as fragmented, of which one has opted in. Partitions that
    the audit log says were rewritten, and rows afterwards, by table."""
    lake = {f"lake.{name}": fragmented(spark, sf_dir) for name in ("events", "prices")}
    manifest = {f"model.{n}": {"name": n, "schema": "lake", "meta": {"compaction": n == "events"}} for n in ("events", "prices")}
    results = [{"unique_id": n, "status": "success"} for n in manifest]
    one = lambda **d: spark.createDataFrame([(json.dumps(d),)], "document string")
    audit = scratch(spark, "audit")
    planner.advise(lake, one(nodes=manifest), one(results=results), audit, spark.createDataFrame([(k,) for k in lake], "table string"))
    rows = functools.reduce(DataFrame.unionByName, (t.read().groupBy().agg(F.count("*").alias("rows")).withColumn("table", F.lit(name)) for name, t in lake.items()))
    done = spark.read.parquet(audit).where("operation = 'compact'").groupBy("table").agg(F.sum("partitions").alias("partitions"))
    return rows.join(done, "table", "left").select("table", F.coalesce("partitions", F.lit(0)).alias("partitions"), "rows")


@query("""SELECT 'dry-run' AS operation, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS partitions, CAST(0 AS BIGINT) AS files_rewritten, true AS unchanged,
  count(*) AS "rows" FROM events""")
def dry_run(spark, sf_dir):
    """What a dry run of compaction logs; the table stays at its snapshot."""
    table, audit = fragmented(spark, sf_dir), scratch(spark, "audit")
    before = table.head()
    planner.run(table, "lake.events", audit, planner.PRESETS["thorough"], dry=True)
    logged = spark.read.parquet(audit).select("operation", "partitions", "files_rewritten", (F.col("before").eqNullSafe(F.col("after")) & F.lit(table.head() == before)).alias("unchanged"))
    return logged.withColumn("rows", F.lit(table.read().count()).cast("long"))


@query("SELECT event_id, event_type FROM events")
def log_rewrite(spark, sf_dir):
    """Rows of two commits after the list of files was rewritten."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type")
    table = VersionedTable(spark, scratch(spark, "log"))
    table.append(rows.where("event_id % 3 = 0"))
    table.append(rows.where("event_id % 3 <> 0"))
    table.rewrite_log()
    return table.read()


@query("SELECT event_id, event_type FROM events")
def branch_merge(spark, sf_dir):
    """Rows added on a branch are in main once it moved there."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type")
    table = VersionedTable(spark, scratch(spark, "branches"))
    table.append(rows.where("event_id % 2 = 0"))
    base = table.branch("work")
    table.append(rows.where("event_id % 2 = 1"), "work")
    table.move("main", base, table.head("work"))
    return table.read()


# Catalogs and storage.

LISTINGS = """c AS (SELECT 'data/' || o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders WHERE o_orderkey % 10 <> 3),
  s AS (SELECT 'data/' || o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 50 = 7 THEN 1 ELSE 0 END AS bytes FROM orders WHERE o_orderkey % 10 <> 4)"""


def listings(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("data/"), F.col("o_orderkey").cast("string")).alias("path"), F.floor("o_totalprice").cast("long").alias("bytes"))
    stored = o.where("o_orderkey % 10 <> 4").withColumn("bytes", F.col("bytes") + (F.col("o_orderkey") % 50 == 7).cast("int"))
    return o.where("o_orderkey % 10 <> 3").select("path", "bytes"), stored.select("path", "bytes")


@query(f"""WITH {LISTINGS} SELECT coalesce(c.path, s.path) AS path,
  CASE WHEN s.path IS NULL THEN 'missing' WHEN c.path IS NULL THEN 'orphan' WHEN c.bytes <> s.bytes THEN 'size_mismatch' ELSE 'ok' END AS status FROM c FULL JOIN s ON c.path = s.path""")
def drift(spark, sf_dir):
    return inventory.drift(*listings(spark, sf_dir))


@query(f"WITH {LISTINGS} SELECT path FROM c WHERE path NOT IN (SELECT path FROM s)")
def drift_missing(spark, sf_dir):
    return inventory.missing(*listings(spark, sf_dir))


@query(f"WITH {LISTINGS} SELECT path FROM s WHERE path NOT IN (SELECT path FROM c)")
def gc_candidates(spark, sf_dir):
    catalog, stored = listings(spark, sf_dir)
    return inventory.missing(stored, catalog)


@query("SELECT n_name AS warehouse, 'main%7C' || replace(n_name, ' ', '+') AS prefix FROM nation")
def catalog_prefix(spark, sf_dir):
    return metadata.default_prefix(metadata.catalog_config(read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))))


@query("SELECT '[' || string_agg('\"' || r_name || '\"', ',' ORDER BY r_name) || ']' AS tenants FROM region")
def tenants_json(spark, sf_dir):
    names = read(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return metadata.tenants(names.unionByName(spark.createDataFrame([("_template",)], "name string")))


@query("SELECT c_custkey, coalesce(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) END, 'none') AS found FROM customer")
def lookup_default(spark, sf_dir):
    table = F.create_map(F.lit("BUILDING"), F.lit("building"), F.lit("MACHINERY"), F.lit("machinery"))
    return read(spark, sf_dir, "customer").select("c_custkey", inventory.looked_up(table, F.col("c_mktsegment"), F.lit("none")).alias("found"))


@query("SELECT r_name AS name FROM region WHERE r_name <> 'ASIA'")
def set_difference(spark, sf_dir):
    return inventory.others(read(spark, sf_dir, "region").select(F.col("r_name").alias("name")), spark.createDataFrame([("ASIA",)], "name string"))


@query("""SELECT 't' || (event_id % 3) AS "table", event_id AS snapshot_id, event_id % 100 AS total_records, event_id % 4 AS manifests_created, event_id % 4 = 0 AS without_data FROM events""")
def snapshot_totals(spark, sf_dir):
    """Totals of snapshots in table documents, and commits without data."""
    docs = read(spark, sf_dir, "events").select(
        F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("table"),
        F.format_string('{"snapshots":[{"snapshot-id":%d,"summary":{"total-records":"%d","manifests-created":"%d"}}]}', "event_id", F.col("event_id") % 100, F.col("event_id") % 4).alias("document"),
    )
    return metadata.snapshots(docs).select("table", "snapshot_id", "total_records", "manifests_created", "without_data")


@query("""SELECT 'model.p.m' || p_partkey AS unique_id, 's.m' || p_partkey AS "table", p_size AS file_count FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 <> 0""")
def models_to_compact(spark, sf_dir):
    """Opted-in models that the last run built, with their tables' health, from a transformation tool's documents of 100 models each."""
    part = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    node = F.struct(F.concat(F.lit("m"), key.cast("string")).alias("name"), F.lit("s").alias("schema"), F.struct((key % 2 == 0).alias("compaction")).alias("meta"))
    name = F.concat(F.lit("model.p.m"), key.cast("string"))
    project = part.groupBy(F.floor(key / 100).alias("project"))
    manifest = project.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(name, node))).alias("nodes"))).alias("document"))
    result = F.struct(name.alias("unique_id"), F.when(key % 5 == 0, "error").otherwise("success").alias("status"))
    results = project.agg(F.to_json(F.struct(F.collect_list(result).alias("results"))).alias("document"))
    rows = part.select(F.concat(F.lit("s.m"), key.cast("string")).alias("table"), F.col("p_size").alias("file_count"))
    return inventory.to_compact(metadata.models(manifest), metadata.run_results(results), rows).select("unique_id", "table", "file_count")


# Documents.

#: Values that the documents of these queries hold in turn.
CASES = ["fine", "", "\x1b[31mred", "No outputs found", "a Warning: b", "PANIC: c", "warning"]


def outputs(spark, sf_dir):
    value = F.get(F.array(*map(F.lit, CASES)), (F.col("doc_id") % len(CASES)).cast("int"))
    keys = [F.lit(k) for k in contract.REQUIRED]
    present = F.filter(F.array(*keys), lambda k, i: (F.col("doc_id") + i) % 3 != 0)
    one = F.map_from_entries(F.transform(present, lambda k: F.struct(k, F.struct(value.alias("value"), F.lit("string").alias("type")))))
    return read(spark, sf_dir, "documents").select("doc_id", contract.unwrapped(one).alias("outputs"))


NAMES = "(VALUES (0, 'kubeconfig_path'), (1, 'node_pool_refs'), (2, 'workload_identity_mechanism'), (3, 'service_account_annotations')) k(i, name)"


@query(f"SELECT doc_id, name FROM documents, {NAMES} WHERE (doc_id + i) % 3 <> 0 AND doc_id % 7 IN (1, 2, 3, 4, 5)")
def contract_garbage(spark, sf_dir):
    return contract.garbage_keys(outputs(spark, sf_dir))


@query(f"SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place FROM documents, {NAMES} WHERE (doc_id + i) % 3 = 0")
def contract_missing(spark, sf_dir):
    return contract.missing_keys(outputs(spark, sf_dir)).select("doc_id", "name", "place")


@query("SELECT event_id, event_id % 5 > 1 AS valid FROM events")
def json_valid(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, F.lit("")).when(F.col("event_id") % 5 == 1, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", contract.is_json(text).alias("valid"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_sum(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS picked FROM orders GROUP BY o_custkey")
def pick_struct(spark, sf_dir):
    """Of each customer's latest order in each status, the one in status F; the lists are as long as there are statuses."""
    latest = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderkey").alias("o_orderkey"))
    items = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")), asc=False)
    each = latest.groupBy("o_custkey").agg(items.alias("items"))
    return each.select("o_custkey", contract.pick(F.col("items"), "o_orderstatus", "F")["o_orderkey"].alias("picked"))


@query("SELECT event_id, strftime(ts + INTERVAL 30 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS expires, event_type AS kind FROM events")
def nested_edit(spark, sf_dir):
    inner = F.struct(F.lit("old").alias("expirationTimestamp"), F.col("event_type").alias("kind"))
    rows = read(spark, sf_dir, "events").select("event_id", "ts", F.struct(F.lit("x").alias("user"), inner.alias("status")).alias("doc"))
    rows = contract.without_field(contract.with_expiry(rows, "doc", "status", scalars.expires(F.col("ts"))), "doc", "user")
    return rows.select("event_id", F.col("doc.status.expirationTimestamp").alias("expires"), F.col("doc.status.kind").alias("kind"))


@query("SELECT n_name FROM nation WHERE n_nationkey % 3 = 2")
def stuck_items(spark, sf_dir):
    n = F.col("n_nationkey") % 3
    finalizers = F.when(n == 0, F.lit(None)).when(n == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("kubernetes")))
    return contract.stuck(read(spark, sf_dir, "nation").withColumn("finalizers", finalizers)).select("n_name")


@query("SELECT p_partkey, p_name FROM part WHERE NOT contains(p_type, 'STEEL') AND contains(lower(p_name), 'a')")
def line_filters(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return contract.lines_with(contract.lines_without(part, "STEEL", "p_type"), "A", "p_name").select("p_partkey", "p_name")


@query("SELECT p_partkey, CASE WHEN p_size >= 8 THEN 'OK' WHEN p_size >= 4 THEN 'WARN' ELSE 'FAIL' END AS grade FROM part")
def thresholds(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", contract.graded("cpu", F.col("p_size")).alias("grade"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def enum_check(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", contract.one_of(F.col("o_orderstatus"), ["F", "O", "P"]).alias("o_orderstatus"))


# Functions.


@query("""SELECT c_custkey, replace(c_name, '#', '_') AS replaced, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, c_custkey // 1024 AS mb,
  CASE WHEN c_custkey % 2 = 0 THEN c_name || chr(10) ELSE '' END || c_mktsegment AS joined, 'oidc.example/' || c_custkey AS host,
  replace(c_mktsegment || '-' || c_custkey, '-', '_') AS underscored, true AS named,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 100 AS INTEGER) ELSE -1 END AS exit_code, base64(encode('{"a":' || c_custkey || '}')) AS packed FROM customer""")
def scalar_functions(spark, sf_dir):
    key = F.col("c_custkey")
    state = F.struct(F.struct((key % 100).cast("int").alias("exitCode")).alias("terminated"))
    status = F.array(F.struct(F.when(key % 3 == 0, "main").otherwise("side").alias("name"), state.alias("state")))
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.replace("c_name", F.lit("#"), F.lit("_")).alias("replaced"),
        scalars.digits(F.col("c_name")).alias("digits"),
        scalars.kb_to_mb(key).alias("mb"),
        scalars.joined_lines(F.array(F.when(key % 2 == 0, F.col("c_name")).otherwise(""), F.lit(None), F.col("c_mktsegment"))).alias("joined"),
        scalars.without_scheme(F.concat(F.lit("https://oidc.example/"), key.cast("string"))).alias("host"),
        scalars.underscored(F.concat_ws("-", "c_mktsegment", key)).alias("underscored"),
        scalars.short_name().rlike("^task-[0-9a-f]{8}$").alias("named"),
        scalars.exit_code(status, "main").alias("exit_code"),
        scalars.to_base64_json(F.struct(key.alias("a"))).alias("packed"),
    )


@query("SELECT r_name AS name, lower(r_name) || '-sa' AS account FROM region")
def map_comprehension(spark, sf_dir):
    names = read(spark, sf_dir, "region").agg(F.collect_list("r_name").alias("names"))
    return names.select(F.explode(scalars.mapped(F.col("names"), lambda n: F.concat(F.lower(n), F.lit("-sa")))).alias("name", "account"))


# Series (F3, W1, G3, G4).

AT, RANGE = "2024-01-20 00:00:00", 5 * 86400
SAMPLES = f"""m AS (SELECT 'p' || (user_id % 10) AS pod, user_id, ts, max(value) AS value FROM events
  WHERE ts > TIMESTAMP '{AT}' - INTERVAL {RANGE} SECOND AND ts <= TIMESTAMP '{AT}' GROUP BY ALL),
  d AS (SELECT pod, user_id, value, lag(value) OVER (PARTITION BY pod, user_id ORDER BY ts) AS before FROM m),
  i AS (SELECT pod, user_id, sum(CASE WHEN value < before THEN value ELSE value - before END) AS increase FROM d GROUP BY pod, user_id HAVING count(*) >= 2)"""


def samples(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    labels = F.create_map(F.lit("namespace"), F.lit("tenant-a"), F.lit("pod"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")))
    made = e.select(F.lit("cpu").alias("metric"), labels.alias("labels"), "user_id", "ts", "value")
    return timeseries.selected(made, "cpu", namespace="tenant-a").withColumn("pod", F.col("labels")["pod"])


@query(f"WITH {SAMPLES} SELECT pod, user_id, round(increase, 4) AS increase FROM i")
def counter_increase(spark, sf_dir):
    return timeseries.increase(samples(spark, sf_dir), ["pod", "user_id"], AT, RANGE).withColumn("increase", F.round("increase", 4))


@query(f"WITH {SAMPLES} SELECT pod, round(sum(increase / {RANGE}.0), 8) AS rate FROM i GROUP BY pod")
def rate_sum_by(spark, sf_dir):
    return timeseries.rate_sum_by(samples(spark, sf_dir), ["pod", "user_id"], "pod", AT, RANGE).withColumn("rate", F.round("rate", 8))


FROM, STEP, SPAN = "2024-01-10 00:00:00", 6 * 3600, 36 * 3600


@query(f"""WITH s AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL),
  g AS (SELECT unnest(generate_series(TIMESTAMP '{FROM}', TIMESTAMP '{AT}', INTERVAL {STEP} SECOND)) AS tick),
  d AS (SELECT user_id, tick, value, lag(value) OVER (PARTITION BY user_id, tick ORDER BY ts) AS before FROM s JOIN g ON ts <= tick AND ts > tick - INTERVAL {SPAN} SECOND),
  i AS (SELECT user_id, tick, sum(CASE WHEN value < before THEN value ELSE value - before END) AS increase FROM d GROUP BY ALL HAVING count(*) >= 2)
  SELECT 'p' || (user_id % 10) AS pod, tick, round(sum(increase / {SPAN}.0), 8) AS rate FROM i GROUP BY ALL""")
def rate_panel(spark, sf_dir):
    """The rate by pod at each step of a range of time."""
    each = timeseries.rate_range(samples(spark, sf_dir), ["pod", "user_id"], FROM, AT, STEP, SPAN)
    return each.groupBy("pod", "tick").agg(F.round(F.sum("rate"), 8).alias("rate"))


@query(f"WITH {SAMPLES}, l AS (SELECT pod, user_id, arg_max(value, ts) AS value FROM m GROUP BY pod, user_id) SELECT pod, round(sum(value), 4) AS value FROM l GROUP BY pod")
def gauge_sum_by(spark, sf_dir):
    return timeseries.gauge_sum_by(samples(spark, sf_dir), ["pod", "user_id"], "pod", AT, RANGE).withColumn("value", F.round("value", 4))


# Streams.


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_ingest(spark, sf_dir):
    """Event files ingested as a stream, in one go; a second call finds nothing new."""
    source, target, checkpoint = (scratch(spark, n) for n in ("source", "target", "progress"))
    events = read(spark, sf_dir, "events")
    events.write.parquet(source)
    if ingest.ingest(spark, source, target, checkpoint, events.schema) == 0 or ingest.ingest(spark, source, target, checkpoint, events.schema):
        raise ValueError("the stream took nothing, or took rows twice")
    return spark.read.schema(events.schema).parquet(target).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def windowed_counts(spark, sf_dir):
    """The aggregation of the stream by tumbling windows, over a whole table."""
    found = ingest.windowed(read(spark, sf_dir, "events"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))


# What Spark SQL gives without code of ours: joins, grouping, windows, set operations.


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def sql_pricing(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query("""SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def sql_rollup(spark, sf_dir):
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.rollup("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def sql_top_per_group(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", place.alias("place")).where("place <= 3")


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def sql_intersect(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: health of an events table that was fragmented on purpose, from its files' metadata, worst first."""
    path = scratch(spark, "entry")
    metadata.fragment(read(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), path, 8, "day")
    return health.scored(health.health(metadata.files(spark, path, "day"))).orderBy(F.desc("score"), "partition")
