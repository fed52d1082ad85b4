"""Queries over the driver's tables, one for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.casts import cast_fallbacks, cast_frame
from .functions.kinds import count_kinds, datetime_share
from .functions.text import WHITE, label, slug
from .operators import dedupe, relate, shapes
from .operators.filters import Filter, apply_filters, partitioned, split_each
from .operators.mapping import AUTO, HYBRID, Field, Nested, expand, nan_as_null, project, select_columns
from .plans.entity import Binder, Entity
from .plans.reports import Metrics, empty_ones, medians, overhead, plan_counts, run_totals
from .run import run_batch as load_all
from .run import run_references as references_of
from .run import run_stream as stream_all
from .sinks.port import JsonFolder, run_to_port
from .sinks.tables import Store, preview, write
from .sources.scan import as_text, combined, load_sources, missing_origins, origin_counts, origins, read_any, sample_per_source, slice_of, tagged, union_sources
from .streaming.keyed import keyed_stream
from .streaming.stream import EntityStream, first_wins, last_wins, run_batches, table_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
    return f"{base.rstrip('/')}/load-{uuid.uuid4().hex}"


# filters


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, sf):
    return apply_filters(table(spark, sf, "orders"), [Filter("o_orderstatus", "==", "F")]).select("o_orderkey", "o_orderstatus")


_KIND = "CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END"


@query(f"SELECT event_id, {_KIND} AS kind FROM events WHERE nullif({_KIND}, '') IS DISTINCT FROM 'click'")
def filter_ne(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("kind"))
    return apply_filters(rows, [Filter("kind", "!=", "click")])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag > 'A'")
def filter_range(spark, sf):
    filters = [Filter("l_quantity", ">=", 10), Filter("l_quantity", "<", 20), Filter("l_returnflag", ">", "A")]
    return apply_filters(table(spark, sf, "lineitem"), filters, {"l_quantity": "float"}).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9)")
def filter_in(spark, sf):
    return apply_filters(table(spark, sf, "part"), [Filter("p_size", "in", [1, 5, "9"])], {"p_size": "integer"}).select("p_partkey", "p_size")


@query(f"SELECT event_id, {_KIND} AS kind FROM events WHERE {_KIND} = '' OR {_KIND} NOT IN ('click', 'view')")
def filter_not_in(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("kind"))
    return apply_filters(rows, [Filter("kind", "not_in", ["click", "view"])])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-17 00:00:00'")
def filter_datetime(spark, sf):
    return apply_filters(table(spark, sf, "orders"), [Filter("o_orderdate", ">=", "1995-06-17")], {"o_orderdate": "datetime"}).select("o_orderkey", "o_orderdate")


@query(
    "SELECT 'orders_' || coalesce(nullif(trim(regexp_replace(o_orderpriority, '[^a-zA-Z0-9_]+', '_', 'g'), '_'), ''), 'value') AS partition, count(*) AS rows "
    "FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '' GROUP BY ALL"
)
def split_each_value(spark, sf):
    filters = [Filter("o_orderstatus", "!=", "P"), Filter("o_orderpriority", "each")]
    rows = partitioned(apply_filters(table(spark, sf, "orders"), filters), filters, "orders")
    return rows.groupBy(F.col("_partition").alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT 'orders_all' AS partition, o_orderkey FROM orders WHERE o_orderstatus <> ''")
def split_fixed_suffix(spark, sf):
    return split_each(table(spark, sf, "orders"), "o_orderstatus", "orders", "all").select(F.col("_partition").alias("partition"), "o_orderkey")


@query(
    "SELECT DISTINCT p_type, coalesce(nullif(trim(regexp_replace(p_type, '[^a-zA-Z0-9_]+', '_', 'g'), '_'), ''), 'value') AS slug, "
    "regexp_replace(p_type, '[^A-Za-z0-9_]', '_', 'g') AS label FROM part"
)
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_type", slug(F.col("p_type")).alias("slug"), label(F.col("p_type")).alias("label")).distinct()


# mapping


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_tax FROM lineitem")
def select_ranges(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select(*select_columns(["l_tax", "1-3", df.columns.index("l_quantity") + 1], df.columns))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def map_manual(spark, sf):
    return project(table(spark, sf, "customer"), (Field("id", "c_custkey", key=True), Field("name", 2), Field("segment", "c_mktsegment")))


@query("SELECT p_partkey AS product_id, p_name, p_brand, p_type, p_size, p_retailprice, p_type AS kind FROM part")
def map_hybrid(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return project(df, expand((Field("product_id", "p_partkey", slot="p_partkey"), Field("kind", "p_type")), df.columns, HYBRID))


@query("SELECT n_nationkey AS id, n_nationkey AS code, n_name AS name FROM nation")
def map_dup_column(spark, sf):
    return project(table(spark, sf, "nation"), (Field("id", "n_nationkey"), Field("code", "n_nationkey"), Field("name", "n_name")))


@query(
    "SELECT 'customers' AS entity, * FROM (VALUES ('id', 'BIGINT', 'manual'), ('c_name', 'TEXT', 'inferred'), ('c_nationkey', 'BIGINT', 'inferred'), ('c_mktsegment', 'TEXT', 'inferred')) t(\"column\", type, origin)"
)
def map_listing(spark, sf):
    sources = {"customer": tagged(as_text(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")), "customer")}
    return Binder(sources).bind(Entity("customers", "relational", (Field("id", "c_custkey", key=True, slot="c_custkey"),), "customer", HYBRID)).listing()


# sources


@query("SELECT s_suppkey, s_name, 'supplier' AS _source FROM supplier")
def tag_source(spark, sf):
    return tagged(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "supplier")


@query("SELECT event_id, user_id, event_type AS _source FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def combined_slice(spark, sf):
    whole = combined(table(spark, sf, "events").select("event_type", "event_id", "user_id"))
    return slice_of(whole, origins(whole).first()["_source"])


@query("SELECT event_type AS _source, count(*) AS rows FROM events GROUP BY ALL")
def origin_rows(spark, sf):
    return origin_counts(combined(table(spark, sf, "events"), "event_type"))


@query(
    "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment, '' AS nation, '' AS brand, 'customer' AS _source FROM customer "
    "UNION ALL SELECT s_suppkey::VARCHAR, s_name, '', s_nationkey::VARCHAR, '', 'supplier' FROM supplier "
    "UNION ALL SELECT p_partkey::VARCHAR, p_name, '', '', p_brand, 'part' FROM part"
)
def union_superset(spark, sf):
    parts = [
        ("customer", {"id": "c_custkey", "name": "c_name", "segment": "c_mktsegment"}),
        ("supplier", {"id": "s_suppkey", "name": "s_name", "nation": "s_nationkey"}),
        ("part", {"id": "p_partkey", "name": "p_name", "brand": "p_brand"}),
    ]
    return union_sources(tagged(as_text(table(spark, sf, n).select(*(F.col(c).alias(a) for a, c in cols.items()))), n) for n, cols in parts)


@query(
    "SELECT event_type AS _source, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 25"
)
def sample_each_source(spark, sf):
    return sample_per_source(combined(table(spark, sf, "events").select("event_type", "event_id", "ts")), 25, ["ts", "event_id"]).select("_source", "event_id", "ts")


# kinds and casts


def _kind_sql(tables: dict[str, list[str]]) -> str:
    one = (
        "SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) FILTER (v <> '') AS filled, count(*) FILTER (lower(trim(v)) IN ('true', 'false')) AS booleans, "
        "count(*) FILTER (v <> '' AND d IS NOT NULL) AS numbers, count(*) FILTER (v <> '' AND d % 1 = 0) AS wholes, "
        "count(*) FILTER (v <> '' AND d IS NULL AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL) AS datetimes "
        "FROM (SELECT v, CASE WHEN regexp_full_match(v, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') THEN TRY_CAST(v AS DOUBLE) END AS d FROM (SELECT coalesce({c}::VARCHAR, '') AS v FROM {t}))"
    )
    union = " UNION ALL ".join(one.format(t=t, c=c) for t, cols in tables.items() for c in cols)
    return (
        "SELECT *, CASE WHEN filled = 0 THEN 'empty' WHEN booleans = filled THEN 'boolean' WHEN numbers = filled THEN CASE WHEN wholes = filled THEN 'integer' ELSE 'float' END "
        f"WHEN datetimes > 0.85 * filled THEN 'datetime' ELSE 'string' END AS kind FROM ({union})"
    )


_KINDS_OF = {"events": ["event_id", "ts", "event_type", "value"], "orders": ["o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice"], "part": ["p_name", "p_size"]}


@query(_kind_sql(_KINDS_OF))
def infer_kinds(spark, sf):
    rows = []
    for t, columns in _KINDS_OF.items():
        for c, n in count_kinds(as_text(table(spark, sf, t).select(*columns))).items():
            rows.append((t, c, n.filled, n.booleans, n.numbers, n.wholes, n.datetimes, n.kind()))
    return spark.createDataFrame(rows, "table string, column string, filled long, booleans long, numbers long, wholes long, datetimes long, kind string")


@query(
    "SELECT count(*) AS filled, count(*) FILTER (TRY_CAST(v AS TIMESTAMP) IS NOT NULL) AS parsed, parsed / filled AS share "
    "FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE o_orderdate::VARCHAR END AS v FROM orders)"
)
def datetime_parse_share(spark, sf):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderdate").cast("string"))
    return datetime_share(table(spark, sf, "orders").select(text.alias("v")), "v")


_CELLS = (
    "SELECT event_id, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN ' ' || event_id || ' ' WHEN 2 THEN '+' || event_id WHEN 3 THEN event_id || '.0' WHEN 4 THEN '1e3' "
    "WHEN 5 THEN event_id || '.25' WHEN 6 THEN 'x' || event_id WHEN 7 THEN '-' || event_id ELSE 'TRUE ' END AS cell FROM events"
)


def _cells(spark, sf):
    i, text = F.col("event_id"), F.col("event_id").cast("string")
    forms = [F.lit(""), F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit("+"), text), F.concat(text, F.lit(".0")), F.lit("1e3"), F.concat(text, F.lit(".25")), F.concat(F.lit("x"), text), F.concat(F.lit("-"), text), F.lit("TRUE ")]
    return table(spark, sf, "events").select("event_id", F.element_at(F.array(*forms), (i % 9 + 1).cast("int")).alias("cell"))


@query(
    rf"SELECT event_id, CASE WHEN regexp_full_match(cell, '\s*[+-]?[0-9]+\s*') THEN TRY_CAST(trim(cell) AS BIGINT) END AS cell, "
    rf"CASE WHEN cell <> '' AND NOT regexp_full_match(cell, '\s*[+-]?[0-9]+\s*') THEN cell END AS rescued FROM ({_CELLS})"
)
def cast_ints(spark, sf):
    out = cast_frame(_cells(spark, sf), {"event_id": "integer", "cell": "integer"})
    return out.select("event_id", "cell", F.try_element_at("_rescued", F.lit("cell")).alias("rescued"))


@query(rf"SELECT event_id, CASE WHEN regexp_full_match(cell, '\s*[+-]?[0-9]+(\.[0-9]+)?(e[0-9]+)?\s*') THEN TRY_CAST(trim(cell) AS DOUBLE) END AS cell FROM ({_CELLS})")
def cast_floats(spark, sf):
    return cast_frame(_cells(spark, sf), {"event_id": "integer", "cell": "float"}, rescue=False)


@query(f"SELECT event_id, CASE WHEN cell <> '' THEN lower(trim(cell)) = 'true' END AS cell FROM ({_CELLS})")
def cast_bools(spark, sf):
    return cast_frame(_cells(spark, sf), {"event_id": "integer", "cell": "boolean"}, rescue=False)


@query(
    rf"SELECT 'event_id' AS \"column\", 'integer' AS kind, 0 AS cells, 'kept as text' AS outcome UNION ALL "
    rf"SELECT 'cell', 'integer', count(*) FILTER (cell <> '' AND NOT regexp_full_match(cell, '\s*[+-]?[0-9]+\s*')), 'kept as text' FROM ({_CELLS})".replace("\\\"", '"')
)
def cast_fallback_counts(spark, sf):
    return cast_fallbacks(_cells(spark, sf), {"event_id": "integer", "cell": "integer"})


# keys


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) = 1")
def dedupe_last(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return dedupe.dedupe(rows, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"])


@query("SELECT event_id, user_id, event_type, ts FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return dedupe.dedupe(rows, ["user_id", "event_type"], ["ts", "event_id"], keep="first")


@query("SELECT event_type, count(*) - count(DISTINCT user_id) AS skipped FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def dup_skipped(spark, sf):
    return dedupe.skipped_duplicates(table(spark, sf, "events"), ["user_id"], ["event_type"])


_LAST = "(SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders WHERE {0} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"
_OLD, _NEW = _LAST.format("o_orderdate < TIMESTAMP '1996-01-01'"), _LAST.format("o_orderdate >= TIMESTAMP '1996-01-01'")


def _loads(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    old, new = rows.where("o_orderdate < timestamp_ntz '1996-01-01'"), rows.where("o_orderdate >= timestamp_ntz '1996-01-01'")
    one = lambda df: dedupe.dedupe(df, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return one(old), one(new)


@query(f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW} WHERE o_custkey NOT IN (SELECT o_custkey FROM {_OLD})")
def insert_if_absent(spark, sf):
    old, new = _loads(spark, sf)
    return dedupe.insert_if_absent(new, old, ["o_custkey"])


@query(f"SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_OLD} WHERE o_custkey NOT IN (SELECT o_custkey FROM {_NEW})")
def upsert_wide(spark, sf):
    old, new = _loads(spark, sf)
    return dedupe.upsert(old, new, ["o_custkey"])


@query(
    f"SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, o.o_orderdate, n.o_totalprice AS last_price FROM {_OLD} o FULL OUTER JOIN {_NEW} n ON o.o_custkey = n.o_custkey"
)
def node_merge(spark, sf):
    old, new = _loads(spark, sf)
    return dedupe.merge_properties(old.drop("o_totalprice"), new.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("last_price")), ["o_custkey"])


# shapes


@query("SELECT o_custkey AS customer, o_orderkey AS \"order\", o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def relational(spark, sf):
    rows = apply_filters(table(spark, sf, "orders"), [Filter("o_orderstatus", "==", "F")])
    fields = (Field("customer", "o_custkey", key=True), Field("order", "o_orderkey"), Field("status", "o_orderstatus"))
    return shapes.to_relational(rows, fields, ["o_orderdate", "o_orderkey"])


@query("SELECT p_partkey AS id, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price FROM part")
def documents(spark, sf):
    fields = (Field("id", "p_partkey"), Nested("item", (Field("brand", "p_brand"), Nested("form", (Field("type", "p_type"), Field("size", "p_size"))))), Field("price", "p_retailprice"))
    return shapes.to_documents(table(spark, sf, "part"), fields).select("id", "item.brand", "item.form.type", "item.form.size", "price")


@query("SELECT c_custkey::VARCHAR AS key, c_name AS name, c_nationkey AS nation, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment, TRUE AS has_segment FROM customer")
def keyvalue_json(spark, sf):
    df = table(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")))
    fields = (Field("c_custkey", key=True), Field("name", "c_name"), Field("nation", "c_nationkey"), Field("segment", "c_mktsegment"))
    out = shapes.to_keyvalue(df, fields, ["c_name"])
    parsed = F.from_json("value", "name string, nation int, segment string")
    return out.select("key", parsed.alias("v"), F.array_contains(F.json_object_keys("value"), "segment").alias("has_segment")).select("key", "v.*", "has_segment")


_LOG = (
    "SELECT o_custkey AS user_id, o_orderdate AS event_time, 'orders' AS event_type, o_orderkey AS ref FROM orders UNION ALL "
    "SELECT l_suppkey, l_shipdate, 'lineitem', l_orderkey * 10 + l_linenumber FROM lineitem UNION ALL SELECT user_id, ts, 'events', event_id FROM events"
)


@query(f"SELECT user_id, event_time, event_type, ref FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY user_id, event_time ORDER BY event_type DESC, ref DESC) = 1")
def activity_log(spark, sf):
    rows = [
        table(spark, sf, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("ref"), F.lit("orders").alias("_source")),
        table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("user"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.lit("lineitem").alias("_source")),
        table(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("event_id").alias("ref"), F.lit("events").alias("_source")),
    ]
    fields = (Field("user_id", "user", key=True), Field("event_time", "at", key=True), Field("event_type", "_source", type="TEXT"), Field("ref"))
    return shapes.to_wide(rows[0].unionByName(rows[1]).unionByName(rows[2]), fields, ["user_id"], ["event_time"], ["_source", "ref"])


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def nodes(spark, sf):
    return shapes.to_nodes(table(spark, sf, "customer"), (Field("id", "c_custkey", key=True), Field("name", "c_name")), ["c_name"])


def _bought(spark, sf):
    items = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    props = (Field("order", "l_orderkey", key=True), Field("line", "l_linenumber"), Field("shipped", "l_shipdate"))
    return people, parts, shapes.to_edges(items, "o_custkey", "l_partkey", "PURCHASED IN", people, "id", parts, "id", props, ["l_linenumber", "l_shipdate", "l_suppkey"])


_EDGES = (
    "(SELECT o_custkey AS src, l_partkey AS dst, 'PURCHASED_IN' AS type, l_orderkey AS \"order\", l_linenumber AS line, l_shipdate AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "WHERE o_custkey IN (SELECT c_custkey FROM customer) AND l_partkey IN (SELECT p_partkey FROM part) "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey, l_partkey, l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_suppkey DESC) = 1)"
)


@query(f"SELECT * FROM {_EDGES}")
def edges(spark, sf):
    return _bought(spark, sf)[2]


@query(f"SELECT src AS from_id, c_name AS from_name, \"order\", line, dst AS to_id, p_brand AS to_brand FROM {_EDGES} JOIN customer ON src = c_custkey JOIN part ON dst = p_partkey")
def graph_readback(spark, sf):
    people, parts, found = _bought(spark, sf)
    out = relate.graph_rows(found, people, "id", parts, "id")
    return out.select(F.col("from.id").alias("from_id"), F.col("from.name").alias("from_name"), "rel.order", "rel.line", F.col("to.id").alias("to_id"), F.col("to.brand").alias("to_brand"))


# references and reports


@query("SELECT 'orders_events_active_by_fk' AS \"constraint\", count(o_custkey) AS \"references\", count(*) FILTER (o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)) AS orphans FROM orders")
def fk_check(spark, sf):
    """Customers of orders against the users of events, which many of them are not."""
    return relate.reference_report(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "events"), "user_id", "active-by", ("orders", "events"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def fk_orphans(spark, sf):
    parent = table(spark, sf, "part").where("p_size > 10")
    return relate.orphans(table(spark, sf, "lineitem"), "l_partkey", parent, "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_partkey, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_unique(spark, sf):
    return dedupe.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    "SELECT 'relational' AS target, 'orders' AS entity, 'orders_' || o_orderstatus AS partition, count(*) AS rows FROM orders GROUP BY ALL UNION ALL "
    "SELECT 'document', 'parts', 'parts', count(*) FROM part WHERE p_size > 20"
)
def plan_row_counts(spark, sf):
    by_status = partitioned(table(spark, sf, "orders"), [Filter("o_orderstatus", "each")], "orders")
    large = partitioned(apply_filters(table(spark, sf, "part"), [Filter("p_size", ">", 20)], {"p_size": "integer"}), [], "parts")
    return plan_counts([("relational", "orders", by_status), ("document", "parts", large)])


_RUNS = "(SELECT event_type AS phase, user_id % 5 AS size, user_id % 2 AS arm, event_id % 3 AS rep, round(value, 2) AS seconds, CASE WHEN event_id % 4 > 0 THEN event_id % 100 END AS peak, event_id % 1000 AS rows FROM events)"


def _runs(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("phase"), (u % 5).alias("size"), (u % 2).alias("arm"), (i % 3).alias("rep"), F.round("value", 2).alias("seconds"), F.when(i % 4 > 0, i % 100).alias("peak"), (i % 1000).alias("rows"),
    )


@query(
    f"SELECT phase, size, round(median(seconds), 6) AS seconds, median(peak) AS peak, max(rows) AS rows, CASE WHEN median(seconds) > 0 THEN round(max(rows) / median(seconds), 3) END AS rows_per_s FROM {_RUNS} WHERE phase <> 'filter' GROUP BY phase, size"
)
def median_report(spark, sf):
    return medians(_runs(spark, sf), ["phase", "size"]).withColumns({"rows_per_s": F.round("rows_per_s", 3), "seconds": F.round("seconds", 6)})


@query(f"SELECT size, rep, round(sum(seconds), 2) AS seconds FROM {_RUNS} WHERE phase <> 'filter' GROUP BY size, rep")
def run_total_report(spark, sf):
    return run_totals(_runs(spark, sf), ["size", "rep"]).withColumn("seconds", F.round("seconds", 2))


_ARM = "(SELECT size, median(s) AS s FROM (SELECT size, rep, sum(seconds) AS s FROM {0} WHERE arm = {1} GROUP BY size, rep) GROUP BY size)"


@query(
    f"SELECT coalesce(a.size, b.size) AS size, round(a.s, 2) AS traced, round(b.s, 2) AS untraced, round((a.s / b.s - 1) * 100, 4) AS overhead_pct FROM {_ARM.format(_RUNS, 0)} a FULL OUTER JOIN {_ARM.format(_RUNS, 1)} b ON a.size = b.size"
)
def overhead_report(spark, sf):
    runs = _runs(spark, sf)
    out = overhead(runs.where("arm = 0"), runs.where("arm = 1"), ["size"], "rep")
    return out.select("size", F.round("traced", 2).alias("traced"), F.round("untraced", 2).alias("untraced"), F.round("overhead_pct", 4).alias("overhead_pct"))


# stored targets and streams


@query(f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW} WHERE o_custkey NOT IN (SELECT o_custkey FROM {_OLD})")
def relational_loads(spark, sf):
    """Two loads of one stored table: rows of the first stay."""
    store = Store(spark, scratch(spark))
    for load in _loads(spark, sf):
        write(load, store, "orders", "relational", ["o_custkey"])
    return store.read("orders")


@query("SELECT 'events_' || event_type AS _partition, event_id AS id, user_id AS \"user\" FROM events")
def stream_route(spark, sf):
    """A stream of text rows split by value into the partitions of one stored table."""
    stream = as_text(table_stream(spark, _several_files(spark, sf)).select("event_id", "user_id", "event_type"))
    entity = Entity("events", "document", (Field("id", "event_id"), Field("user", "user_id")), filters=(Filter("event_type", "each"),))
    store, work = Store(spark, scratch(spark)), scratch(spark)
    run_batches(stream, EntityStream(store, [entity], {"event_id": "integer", "user_id": "integer"}), f"{work}/checkpoint")
    return store.read("events").select("_partition", "id", "user")


def _several_files(spark, sf):
    """events as a folder of several files, so that a stream of it has several batches, in no order of time."""
    path = scratch(spark)
    table(spark, sf, "events").repartition(4, "event_id").write.parquet(path)
    return path


def _keyed(spark, sf, rule):
    stream = table_stream(spark, _several_files(spark, sf)).select("user_id", "event_id", "event_type", "ts").where("user_id is not null")
    store, work = Store(spark, scratch(spark)), scratch(spark)
    run_batches(stream, lambda batch, k: rule(store, "users", batch, ["user_id"], ["ts", "event_id"], k), f"{work}/checkpoint")
    return store.read("users")


@query("SELECT user_id, event_id, event_type, ts FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def stream_first_wins(spark, sf):
    return _keyed(spark, sf, first_wins)


@query("SELECT user_id, event_id, event_type, ts FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_last_wins(spark, sf):
    return _keyed(spark, sf, last_wins)


def _by_state(spark, sf, wins):
    """Winners held in RocksDB by user, over files in no order of time."""
    stream = table_stream(spark, _several_files(spark, sf)).select("user_id", "event_id", "event_type", "ts")
    store, work = Store(spark, scratch(spark)), scratch(spark)
    keyed_stream(store, "users", stream, ["user_id"], ["ts", "event_id"], f"{work}/checkpoint", wins)
    return store.read("users")


@query("SELECT user_id, event_id, event_type, ts FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def stream_state_first(spark, sf):
    return _by_state(spark, sf, "first")


@query("SELECT user_id, event_id, event_type, ts FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_state_last(spark, sf):
    return _by_state(spark, sf, "last")


# loads that follow each other


_BY_USER = "(SELECT user_id, event_id, event_type, ts FROM events WHERE user_id IS NOT NULL AND {0} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)"
_CLICKS, _OTHERS = _BY_USER.format("event_type = 'click'"), _BY_USER.format("event_type IS DISTINCT FROM 'click'")


@query(f"SELECT * FROM {_OTHERS} UNION ALL SELECT * FROM {_CLICKS} WHERE user_id NOT IN (SELECT user_id FROM {_OTHERS})")
def stream_two_loads(spark, sf):
    """Two streams into one target, their batches numbered alike: each keeps its first row of a key, the later load's rows take the place of the earlier one's."""
    store, work, found = Store(spark, scratch(spark)), scratch(spark), table(spark, sf, "events")
    for k, rows in enumerate((found.where("event_type = 'click'"), found.where("not event_type <=> 'click'"))):
        rows.repartition(3, "event_id").write.parquet(f"{work}/in{k}")
        stream = table_stream(spark, f"{work}/in{k}").select("user_id", "event_id", "event_type", "ts").where("user_id is not null")
        run_batches(stream, lambda batch, n: first_wins(store, "users", batch, ["user_id"], ["ts", "event_id"], n), f"{work}/c{k}")
    return store.read("users")


@query(
    "SELECT coalesce(c_custkey, o_custkey)::BIGINT AS id, CASE WHEN o_custkey IS NULL THEN c_name ELSE o_orderpriority END AS name, c_nationkey::BIGINT AS nation, o_orderkey::BIGINT AS first_order "
    "FROM customer FULL OUTER JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON c_custkey = o_custkey"
)
def graph_reload(spark, sf):
    """Nodes loaded by a batch and again by a stream: of the stream the first row of a key counts, and overwrites the properties that it carries."""
    store, work = Store(spark, scratch(spark)), scratch(spark)
    people = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"))
    write(shapes.to_nodes(people, (Field("id", key=True), Field("name"), Field("nation")), ["name"]), store, "people", "graph", ["id"])
    table(spark, sf, "orders").repartition(3, "o_orderkey").write.parquet(f"{work}/in")
    stream = as_text(table_stream(spark, f"{work}/in").select("o_custkey", "o_orderkey", "o_orderpriority"))
    entity = Entity("people", "graph", (Field("id", "o_custkey", key=True), Field("name", "o_orderpriority"), Field("first_order", "o_orderkey")), order=("o_orderkey",))
    run_batches(stream, EntityStream(store, [entity], {"o_custkey": "integer", "o_orderkey": "integer"}), f"{work}/checkpoint")
    return store.read("people").select("id", "name", "nation", "first_order")


@query("SELECT s_suppkey, s_name FROM supplier")
def store_clean(spark, sf):
    """A target that forgets what it held before another load."""
    store = Store(spark, scratch(spark))
    write(table(spark, sf, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name")), store, "t", "relational", ["s_suppkey"])
    store.clean("t")
    write(table(spark, sf, "supplier").select("s_suppkey", "s_name"), store, "t", "relational", ["s_suppkey"])
    return store.read("t")


_RUN = {
    "relational": {"entities": {"orders": {"columns": {"orderkey": {"is_key": True}, "custkey": {}, "price": {}}, "filters": [{"column": "status", "operator": "each"}]}}},
    "document": {"entities": {"people": {"source": "customer", "columns": {"custkey": {}, "about": {"name": {}, "segment": {}}}, "filters": [{"column": "segment", "operator": "!=", "value": "BUILDING"}]}}},
    "keyvalue": {"entities": {"names": {"source": "customer", "columns": {"custkey": {"is_key": True}, "name": {}}}}},
    "wide": {"entities": {"seen": {"source": ["customer", "orders"], "columns": {"custkey": {}, "kind": {"csv_column": "_source"}}, "partition": ["custkey"], "cluster": ["kind"]}}},
    "graph": {
        "entities": {
            "person": {"source": "customer", "columns": {"custkey": {"is_key": True}, "name": {}}},
            "purchase": {"source": "orders", "columns": {"orderkey": {"is_key": True}}, "filters": [{"column": "status", "operator": "in", "value": ["F", "O"]}]},
        },
        "relationships": {"placed": {"from": "purchase", "to": "person", "type": "PLACED BY", "columns": {"price": {}}}},
    },
}
_RUN_SQL = (
    "SELECT 'orders' AS entity, 'orders_' || o_orderstatus AS partition, o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS other, o_totalprice::DOUBLE AS price FROM orders "
    "UNION ALL SELECT 'people', 'people', c_custkey::VARCHAR, c_name || c_mktsegment, NULL FROM customer WHERE c_mktsegment <> 'BUILDING' "
    "UNION ALL SELECT 'names', 'names', c_custkey::VARCHAR, c_name, NULL FROM customer "
    "UNION ALL SELECT 'seen', 'seen', c_custkey::VARCHAR, 'customer', NULL FROM customer UNION ALL SELECT DISTINCT 'seen', 'seen', o_custkey::VARCHAR, 'orders', NULL FROM orders "
    "UNION ALL SELECT 'person', 'person', c_custkey::VARCHAR, c_name, NULL FROM customer UNION ALL SELECT 'purchase', 'purchase', o_orderkey::VARCHAR, NULL, NULL FROM orders WHERE o_orderstatus IN ('F', 'O') "
    "UNION ALL SELECT 'PLACED_BY', 'PLACED_BY', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_totalprice::DOUBLE FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey IN (SELECT c_custkey FROM customer)"
)


def _run_config(spark, sf):
    """Text copies of two tables, and the configuration that loads them into every model."""
    folder = scratch(spark)
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    orders.repartition(2, "orderkey").write.csv(f"{folder}/orders", header=True)
    people.write.csv(f"{folder}/customer", header=True)
    return {"sources": {n: f"{folder}/{n}" for n in ("orders", "customer")}} | _RUN, f"{folder}/targets", f"{folder}/checkpoints"


def _run_rows(spark, root):
    """All that the run has stored, as rows of one form."""
    at = lambda model, name: Store(spark, f"{root}/{model}").read(name)
    none = F.lit(None)
    found = [
        ("orders", at("relational", "orders"), F.col("orderkey"), F.col("custkey"), F.col("price")),
        ("people", at("document", "people"), F.col("custkey"), F.concat("about.name", "about.segment"), none),
        ("names", at("keyvalue", "names"), F.col("key"), F.get_json_object("value", "$.name"), none),
        ("seen", at("wide", "seen"), F.col("custkey"), F.col("kind"), none),
        ("person", at("graph", "person"), F.col("custkey"), F.col("name"), none),
        ("purchase", at("graph", "purchase"), F.col("orderkey"), none, none),
        ("PLACED_BY", at("graph", "PLACED_BY"), F.col("src"), F.col("dst"), F.col("price")),
    ]
    parts = [
        df.select(F.lit(n).alias("entity"), (F.col("_partition") if "_partition" in df.columns else F.lit(n)).alias("partition"), i.cast("string").alias("id"), o.cast("string").alias("other"), p.cast("double").alias("price"))
        for n, df, i, o, p in found
    ]
    return reduce(DataFrame.unionByName, parts)


@query(_RUN_SQL)
def run_batch(spark, sf):
    """One configuration over text files, without a declared order, into the targets of all five models."""
    config, root, _ = _run_config(spark, sf)
    load_all(spark, config, root)
    return _run_rows(spark, root)


@query(_RUN_SQL)
def run_stream(spark, sf):
    """The same configuration by streams, a streamed union among them; edges in a second pass."""
    config, root, checkpoints = _run_config(spark, sf)
    stream_all(spark, config, root, checkpoints)
    return _run_rows(spark, root)


@query(
    "SELECT 'relational' AS target, 'orders' AS entity, 'orders_' || o_orderstatus AS partition, count(*) AS rows FROM orders GROUP BY ALL UNION ALL SELECT 'document', 'people', 'people', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' "
    "UNION ALL SELECT 'graph', 'person', 'person', count(*) FROM customer UNION ALL SELECT 'graph', 'purchase', 'purchase', count(*) FROM orders WHERE o_orderstatus IN ('F', 'O') "
    "UNION ALL SELECT 'graph', 'PLACED BY', 'PLACED_BY', count(*) FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey IN (SELECT c_custkey FROM customer)"
)
def run_plan(spark, sf):
    """What a load of three chosen models would store; nothing is stored."""
    config, root, _ = _run_config(spark, sf)
    return load_all(spark, config, root, only=["relational", "document", "graph"], dry_run=True)


@query("SELECT l_orderkey, count(*) AS n, sum(l_partkey::HUGEINT * 1000000000000000000)::DECIMAL(38, 0)::VARCHAR AS total FROM lineitem GROUP BY ALL")
def cast_wide(spark, sf):
    """Integers of more digits than 64 bits hold, through a binder."""
    text = as_text(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_partkey").cast("string"), F.lit("0" * 18)).alias("big")))
    entity = Entity("items", "document", (Field("l_orderkey"), Field("big")))
    rows = Binder({"items": tagged(text, "items")}).bind(entity).shaped()
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("big").cast("string").alias("total"))


_METRICS_SQL = (
    "SELECT 'relational' AS target, 'orders' AS entity, 'write' AS phase, 'orders_' || o_orderstatus AS partition, count(*) AS rows FROM orders GROUP BY ALL UNION ALL SELECT 'document', 'people', 'write', 'people', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' "
    "UNION ALL SELECT 'relational', 'orders', 'filter', NULL, count(*) FROM orders UNION ALL SELECT 'document', 'people', 'filter', NULL, count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' "
    "UNION ALL SELECT 'relational', 'orders', 'rescue', NULL, 0 UNION ALL SELECT 'document', 'people', 'rescue', NULL, 0"
)


@query(_METRICS_SQL)
def run_metrics(spark, sf):
    """Rows that a run's own jobs counted: let through by the filters, rescued, and written to each partition."""
    config, root, _ = _run_config(spark, sf)
    metrics = Metrics()
    load_all(spark, config, root, only=["relational", "document"], metrics=metrics)
    found = metrics.frame(spark).where("phase in ('filter', 'rescue') or partition is not null")
    return found.select("target", "entity", "phase", "partition", "rows")


@query(
    "SELECT 'orders_people_placed_by_fk' AS \"constraint\", count(o_custkey) AS \"references\", count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')) AS orphans FROM orders "
    "UNION ALL SELECT 'items_orders_of_fk', count(*), count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem"
)
def run_references(spark, sf):
    """All foreign keys of a run, in one pass over what it has stored; nobody of one segment is stored."""
    config, root, _ = _run_config(spark, sf)
    items = f"{root}-items"
    table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line")).write.csv(items, header=True)
    entities = {
        "orders": {"columns": {"orderkey": {"is_key": True}, "custkey": {}}},
        "people": {"source": "customer", "columns": {"custkey": {"is_key": True}}, "filters": [{"column": "segment", "operator": "!=", "value": "BUILDING"}]},
        "items": {"columns": {"orderkey": {}, "line": {}}},
    }
    relations = {"placed-by": {"from": "orders", "to": "people", "foreign_key": "custkey"}, "of": {"from": "items", "to": "orders", "foreign_key": "orderkey"}}
    config = {"sources": config["sources"] | {"items": items}, "relational": {"entities": entities, "relationships": relations}}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # dangling keys are what the report is of
        load_all(spark, config, root)
    return references_of(spark, config, root)


@query("SELECT o_orderkey::VARCHAR AS id, o_orderpriority || chr(10) || chr(10) || '\"x\", ' || o_orderstatus AS text, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status FROM orders")
def scan_quoted(spark, sf):
    """Text files whose quoted fields hold line breaks and quotes, read in parallel."""
    path = f"{scratch(spark)}/rows.csv"
    text = F.concat(F.col("o_orderpriority"), F.lit('\n\n"x", '), F.col("o_orderstatus"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    rows.repartition(3, "id").write.csv(path, header=True, escape='"')
    return read_any(spark, path).select("id", "text", "status")


# the rest of the mapping, and casts of odd texts


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def map_auto(spark, sf):
    df = tagged(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "supplier")
    return project(df, expand((), df.columns, AUTO))


@query("SELECT p_name, p_brand, p_size, p_partkey AS id FROM part")
def map_restricted(spark, sf):
    """An automatic mapping of some columns, by name and by place, beside one that is given."""
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return project(df, expand((Field("id", "p_partkey"),), df.columns, HYBRID, ["2-3", "p_size"]))


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN value END AS value, CASE WHEN event_id % 5 > 0 THEN value END AS inner_value FROM events")
def nan_to_null(spark, sf):
    odd = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = nan_as_null(table(spark, sf, "events").select("event_id", odd.alias("value"), F.struct(odd.alias("v")).alias("inner")))
    return rows.select("event_id", "value", F.col("inner.v").alias("inner_value"))


@query("SELECT 'log_' || event_type AS partition, count(*) AS rows FROM events GROUP BY ALL")
def split_by_source(spark, sf):
    rows = partitioned(combined(table(spark, sf, "events").select("event_type", "event_id")), [Filter("_source", "each")], "log")
    return rows.groupBy(F.col("_partition").alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "SELECT DISTINCT CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS src, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey END AS dst, 'PLACED' AS type FROM orders "
    "WHERE src IN (SELECT c_custkey FROM customer) AND dst IS NOT NULL"
)
def edges_null_ends(spark, sf):
    """Rows of which either end may be null draw no edge."""
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    rows = orders.select(F.when(key % 4 > 0, F.col("o_custkey")).alias("who"), F.when(key % 7 > 0, key).alias("what"), "o_orderdate", key.alias("place"))
    return shapes.to_edges(rows, "who", "what", "PLACED", table(spark, sf, "customer"), "c_custkey", orders, "o_orderkey", (), ["o_orderdate", "place"])


@query("SELECT 'events_of_no_kind' AS entity")
def empty_targets(spark, sf):
    """Which of the expected targets no row goes to."""
    rows = partitioned(table(spark, sf, "events"), [Filter("event_type", "each")], "events")
    counts = plan_counts([("document", "events", rows), ("document", "all", partitioned(table(spark, sf, "orders"), [], "all"))])
    return empty_ones(counts, ["events", "all", "events_of_no_kind"])


@query("SELECT * FROM (VALUES ('customer', 'int', TRUE), ('order', 'bigint', FALSE), ('status', 'string', FALSE)) t(name, type, key)")
def target_columns(spark, sf):
    """Names, types and keys of a relational target."""
    rows = table(spark, sf, "orders").withColumns({"o_custkey": F.col("o_custkey").cast("int"), "o_orderkey": F.col("o_orderkey").cast("long")})
    fields = (Field("customer", "o_custkey", key=True), Field("order", "o_orderkey"), Field("status", "o_orderstatus"))
    return spark.createDataFrame(shapes.target_schema(shapes.to_relational(rows, fields, ["o_orderdate"]), fields), "name string, type string, key boolean")


_DATES = ("%Y-%m-%dT%H:%M:%SZ", "%m/%d/%Y", "%d %b %Y", "%Y/%m/%d %H:%M:%S", "%B %d, %Y", "%Y%m%dT%H%M%S")
_FORMS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "MM/dd/yyyy", "dd MMM yyyy", "yyyy/MM/dd HH:mm:ss", "MMMM dd, yyyy", "yyyyMMdd'T'HHmmss")


@query("SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 7 IN (0, 3, 5) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d 00:00:00') END AS at FROM events")
def cast_datetimes(spark, sf):
    """Dates in ISO and free forms; a text that is none becomes null."""
    rows = table(spark, sf, "events")
    texts = F.array(*(F.date_format("ts", f) for f in _FORMS), F.lit("some day"))
    found = cast_frame(rows.select("event_id", F.element_at(texts, (F.col("event_id") % 7 + 1).cast("int")).alias("at")), {"event_id": "integer", "at": "datetime"}, rescue=False)
    return found.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT event_id, event_id % 2 = 0 AS flag, -event_id AS whole, event_id + 0.5::DOUBLE AS part FROM events")
def cast_white(spark, sf):
    """White space of any kind around values."""
    i, white = F.col("event_id"), F.array(*map(F.lit, WHITE))
    pad = F.element_at(white, (i % len(WHITE) + 1).cast("int"))
    around = lambda c: F.concat(pad, c.cast("string"), pad)
    rows = table(spark, sf, "events").select("event_id", around(F.when(i % 2 == 0, "TRUE").otherwise("False")).alias("flag"), around(-i).alias("whole"), around(i + 0.5).alias("part"))
    return cast_frame(rows, {"event_id": "integer", "flag": "boolean", "whole": "integer", "part": "float"}, rescue=False)


@query("SELECT o_orderkey::VARCHAR AS key, o_custkey AS customer, o_orderstatus AS status FROM orders")
def keyvalue_orders(spark, sf):
    fields = (Field("o_orderkey", key=True), Field("customer", "o_custkey"), Field("status", "o_orderstatus"))
    out = shapes.to_keyvalue(table(spark, sf, "orders"), fields, ["o_orderdate"])
    return out.select("key", F.from_json("value", "customer long, status string").alias("v")).select("key", "v.*")


# what a store holds and how it lies there


@query("SELECT 'seen_' || event_type AS partition, count(*) AS rows, 0::BIGINT AS disordered, 0::BIGINT AS overlaps FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL")
def wide_order(spark, sf):
    """Wide rows as they lie on disk: sorted by their keys in each file, the files of a partition with ranges of their own."""
    store = Store(spark, scratch(spark))
    rows = partitioned(table(spark, sf, "events").where("user_id is not null"), [Filter("event_type", "each")], "seen")
    fields = (Field("user_id", key=True), Field("event_id", key=True), Field("ts"))
    folder = write(shapes.to_wide(rows, fields, ["user_id"], ["event_id"], ["ts"]), store, "seen", "wide", ["user_id", "event_id"])
    return store.order_report(folder, ["user_id", "event_id"])


@query("SELECT o_orderstatus AS status, count(*) AS rows, TRUE AS small FROM orders GROUP BY ALL")
def flush_size(spark, sf):
    """Rows of each partition, and whether no file holds more than was asked for."""
    store = Store(spark, scratch(spark), rows_per_file=1000)
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("_partition"))
    folder = write(rows, store, "orders", "document")
    files = spark.read.option("basePath", folder).parquet(folder).groupBy(F.col("_partition").alias("status"), "_metadata.file_path").agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy("status").agg(F.sum("n").alias("rows"), (F.max("n") <= 1000).alias("small"))


@query("SELECT o_custkey::VARCHAR AS key, o_orderkey AS \"order\", o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def keyvalue_last(spark, sf):
    """Keys that many rows have, stored and read back: the last row of a key is its value."""
    store = Store(spark, scratch(spark))
    fields = (Field("o_custkey", key=True), Field("order", "o_orderkey"), Field("status", "o_orderstatus"))
    write(shapes.to_keyvalue(table(spark, sf, "orders"), fields, ["o_orderdate", "o_orderkey"]), store, "last", "keyvalue", ["key"])
    return shapes.from_keyvalue(store.read("last"), "order long, status string")


@query("SELECT o_orderkey::VARCHAR AS ref, o_custkey AS who, o_totalprice::DECIMAL(18, 2)::VARCHAR AS price FROM orders")
def text_coercion(spark, sf):
    """Numbers in columns that the target declares as text."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderdate")
    fields = (Field("who", "o_custkey", key=True), Field("ref", "o_orderkey", key=True, type="TEXT"), Field("price", type="TEXT"))
    return shapes.to_wide(rows, fields, ["who"], ["ref"], ["o_orderdate"]).select("ref", "who", "price")


@query("SELECT 'region' AS name, r_name AS shown, count(*) OVER () AS rows FROM region UNION ALL SELECT 'orders', NULL, count(*) FROM orders")
def preview_or_count(spark, sf):
    """A small table's rows, and of a large one only how many there are."""
    out = []
    for name, column in (("region", "r_name"), ("orders", "o_orderstatus")):
        rows, n = preview(table(spark, sf, name).select(column))
        out += [(name, r[0], n) for r in rows] or [(name, None, n)]
    return spark.createDataFrame(out, "name string, shown string, rows long")


# sources


@query(
    "SELECT 'customer' AS entity, count(*) AS rows, 0::BIGINT AS only_combined, 0::BIGINT AS only_files FROM customer UNION ALL SELECT 'supplier', count(*), 0, 0 FROM supplier"
)
def mode_equivalence(spark, sf):
    """Entities of one combined text file and of a file for each, compared row by row both ways."""
    folder = scratch(spark)
    parts = {
        "customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        "supplier": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")),
    }
    for name, rows in parts.items():
        rows.write.csv(f"{folder}/{name}", header=True)
    whole = union_sources(tagged(as_text(rows), name) for name, rows in parts.items())
    whole.select(F.col("_source").alias("origin"), "id", "name", "segment", "nation").write.csv(f"{folder}/all", header=True)
    together = Binder(load_sources(spark, {"all": {"file": f"{folder}/all", "origin_column": True}}))
    apart = Binder(load_sources(spark, {name: f"{folder}/{name}" for name in parts}))

    def one(name: str, rest: str) -> DataFrame:
        entity = Entity(name, "document", (Field("id"), Field("name"), Field(rest)), name)
        a, b = (x.bind(entity).shaped().withColumn("n", F.lit(1)) for x in (together, apart))
        sides = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
        sums = sides.groupBy("id", "name", rest).agg(F.sum("side").alias("d"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("n"))
        return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_combined"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_files")).select(F.lit(name).alias("entity"), "*")

    return one("customer", "segment").unionByName(one("supplier", "nation"))


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS name, 'people' AS _source FROM supplier")
def source_override(spark, sf):
    """A declared path that another takes the place of when it is loaded."""
    folder = scratch(spark)
    for name, key, text in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name")):
        table(spark, sf, name).select(F.col(key).alias("id"), F.col(text).alias("name")).write.csv(f"{folder}/{name}", header=True)
    return load_sources(spark, {"people": "customer"}, {"people": f"{folder}/supplier"}, base=folder)["people"].select("id", "name", "_source")


@query("SELECT w AS _source FROM (VALUES ('click'), ('recall')) t(w) WHERE w NOT IN (SELECT event_type FROM events)")
def origins_absent(spark, sf):
    """Origins that are asked for and that no row has."""
    return missing_origins(combined(table(spark, sf, "events"), "event_type"), ["click", "recall"])


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING'")
def port_stream(spark, sf):
    """Documents through a streaming port: a batch for each file, committed as a whole."""
    work = scratch(spark)
    table(spark, sf, "customer").repartition(3, "c_custkey").write.parquet(f"{work}/in")
    stream = apply_filters(table_stream(spark, f"{work}/in"), [Filter("c_mktsegment", "!=", "BUILDING")])
    out = f"{work}/out".removeprefix("file://")
    run_to_port(shapes.to_documents(stream, (Field("id", "c_custkey"), Nested("about", (Field("name", "c_name"),)))), JsonFolder(out), f"{work}/checkpoint")
    return spark.read.schema("id int, about struct<name string>").json(f"file://{out}").select("id", "about.name")
