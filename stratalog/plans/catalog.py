"""Named queries over the supplied tables, with the SQL that gives the same rows.

``events`` is read as a write log (entity = user_id, comp = event_type, tick = hours since 2024-01-01, seq = event_id),
signups and errors as births and deaths, orders and lineitems as relations, embeddings as positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import geometry as g
from ..functions import numeric as num
from ..operators import delta, devtools, graph, interest, nav, schema, spatial, temporal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def engine(spark: SparkSession, sf: str, *names: str) -> Engine:
    e = Engine(spark)
    for n in names:
        e.register(n, table(spark, sf, n))
    return e


def gql(name: str, text: str, tables: tuple[str, ...], sql: str) -> None:
    query(name, sql)(lambda spark, sf: engine(spark, sf, *tables).query(text))


# --- the tables' readings ---


def tick() -> Column:
    return F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 3600000000).cast("long")


TICK = "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000) AS BIGINT)"
LOG = f"log AS (SELECT {TICK} AS tick, event_id AS seq, user_id AS entity, event_type AS comp, value FROM events)"
LIFE = "life AS (SELECT tick, seq, entity, comp = 'signup' AS spawned FROM log WHERE comp IN ('signup', 'error'))"
POS = "pos AS (SELECT vec_id AS entity, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
ORDER_EDGES = "edges AS (SELECT o_orderkey AS src, 0 AS kind, o_custkey AS dst, o_totalprice AS payload FROM orders)"


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(tick().alias("tick"), F.col("event_id").alias("seq"), F.col("user_id").alias("entity"), F.col("event_type").alias("comp"), "value")


def life(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf).where(F.col("comp").isin("signup", "error"))
    return rows.select("tick", "seq", "entity", F.lit(None).cast("string").alias("prefab"), (F.col("comp") == "signup").alias("spawned"))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity"), "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Many positions: quantity, price and discount of lineitems."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(key.alias("entity"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


ITEMS = "items AS (SELECT l_orderkey * 10 + l_linenumber AS entity, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"


def order_edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.lit(0).alias("kind"), F.col("o_custkey").alias("dst"), F.col("o_totalprice").alias("payload"))


COMPS = ["click", "purchase", "view"]
LAST = "last AS (SELECT entity, comp, arg_max(value, (tick, seq)) AS value, max(tick) AS tick FROM log WHERE tick <= {t} GROUP BY entity, comp)"
WIDE = "w AS (SELECT e.entity, max(CASE WHEN l.comp = 'click' THEN l.value END) AS click, max(CASE WHEN l.comp = 'purchase' THEN l.value END) AS purchase, max(CASE WHEN l.comp = 'view' THEN l.value END) AS view FROM (SELECT DISTINCT entity FROM log) e LEFT JOIN last l ON e.entity = l.entity GROUP BY e.entity)"
SIG = "(CASE WHEN click IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN purchase IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN view IS NOT NULL THEN 4 ELSE 0 END)"


def wide(spark: SparkSession, sf: str, t: int) -> DataFrame:
    rows = log(spark, sf)
    return temporal.wide(temporal.as_of(rows, t), rows.select("entity").distinct(), COMPS)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """SELECT … AT TICK over the log's wide view."""
    e = Engine(spark).register("users", wide(spark, sf, 360).drop("signature").withColumn("tick", F.lit(360)))
    return e.query("SELECT entity, click, purchase, view FROM users AT TICK 360 WHERE HAS purchase AND click > 50 ORDER BY click DESC, entity LIMIT 20")


# --- the language ---

gql("gql_select_filter_order_limit", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 10", ("customer",), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
gql(
    "gql_expression_precedence",
    "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity + 2 * l_tax - l_discount / 4 AS v, l_linenumber % 3 AS m FROM lineitem WHERE l_quantity > 30 AND l_tax < 0.02 OR l_discount = 0.1 && l_linenumber <> 2",
    ("lineitem",),
    "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity + 2 * l_tax - l_discount / 4 AS v, l_linenumber % 3 AS m FROM lineitem WHERE (l_quantity > 30 AND l_tax < 0.02) OR (l_discount = 0.1 AND l_linenumber <> 2)",
)
gql("gql_comparison_chain", "SELECT p_partkey FROM part WHERE 10 < p_size < 1 OR NOT (p_size >= 5)", ("part",), "SELECT p_partkey FROM part WHERE (CASE WHEN 10 < p_size THEN 1 ELSE 0 END) < 1 OR NOT (p_size >= 5)")
gql("gql_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", ("customer",), "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
gql("gql_select_star", "SELECT * FROM supplier WHERE s_acctbal < -500", ("supplier",), "SELECT * FROM supplier WHERE s_acctbal < -500")
gql(
    "gql_in_between_like_is",
    "SELECT o_orderkey, o_orderpriority AS p FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 150000 AND o_orderpriority NOT LIKE '%LOW' AND o_custkey IS NOT NULL",
    ("orders",),
    "SELECT o_orderkey, o_orderpriority AS p FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 150000 AND o_orderpriority NOT LIKE '%LOW' AND o_custkey IS NOT NULL",
)
gql(
    "gql_group_by_having",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 2) AS qty, round(AVG(l_extendedprice), 4) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10",
    ("lineitem",),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY ALL HAVING count(*) > 10",
)
gql(
    "gql_join_group_order",
    "SELECT n_name, COUNT(*) AS customers, MIN(c_acctbal) AS low, MAX(c_acctbal) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA' GROUP BY n_name ORDER BY customers DESC, n_name LIMIT 12 OFFSET 2",
    ("customer", "nation", "region"),
    "SELECT n_name, count(*) AS customers, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name ORDER BY customers DESC, n_name LIMIT 12 OFFSET 2",
)
gql("gql_left_join", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", ("customer", "orders"), "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
gql("gql_set_operations", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0 UNION SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3", ("customer", "supplier", "nation"), "(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) UNION SELECT n_nationkey FROM nation WHERE n_nationkey < 3")
gql(
    "gql_case_functions",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS state, upper(substring(c_mktsegment, 1, 3)) AS seg, abs(c_acctbal) AS size FROM customer",
    ("customer",),
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS state, upper(substring(c_mktsegment, 1, 3)) AS seg, abs(c_acctbal) AS size FROM customer",
)


@query("gql_find_near", f"WITH {POS} SELECT entity, x, y, z FROM pos WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.1 AND 0.1 AND label < 5")
def _(spark, sf):
    return Engine(spark).register("objects", positions(spark, sf)).query("FIND objects NEAR (0, 0, 0) WITHIN 0.1 WHERE label < 5").select("entity", "x", "y", "z")


@query("gql_distance_function", f"WITH {POS} SELECT entity, round(sqrt((x-0.05)*(x-0.05)+(y+0.02)*(y+0.02)+z*z), 9) AS d FROM pos WHERE sqrt((x-0.05)*(x-0.05)+(y+0.02)*(y+0.02)+z*z) < 0.12")
def _(spark, sf):
    p = positions(spark, sf).select("entity", F.struct("x", "y", "z").alias("pos"))
    return Engine(spark).register("players", p).query("SELECT entity, round(distance(pos, [0.05, -0.02, 0]), 9) AS d FROM players WHERE distance(pos, [0.05, -0.02, 0]) < 0.12")


@query("gql_at_tick", f"WITH {LOG}, t AS (SELECT * FROM log WHERE tick <= 100) SELECT entity, count(*) AS n, round(max(value), 4) AS most FROM t WHERE comp = 'purchase' GROUP BY entity")
def _(spark, sf):
    return Engine(spark).register("log", log(spark, sf)).query("SELECT entity, COUNT(*) AS n, round(MAX(value), 4) AS most FROM log AT TICK 100 WHERE comp = 'purchase' GROUP BY entity")


@query("gql_write_statements", "SELECT * FROM (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'one' ELSE n_name END AS name, n_regionkey AS r FROM nation WHERE n_regionkey <> 3) UNION ALL SELECT 99, 'new', -1")
def _(spark, sf):
    e = Engine(spark).register("t", table(spark, sf, "nation").selectExpr("n_nationkey k", "n_name name", "n_regionkey r"))
    for text in ("UPDATE t SET name = 'one' WHERE r = 1", "DELETE FROM t WHERE r = 3", "INSERT INTO t (k, name, r) VALUES (99, 'new', -1)"):
        e.query(text)
    return e.query("SELECT * FROM t")


@query("listen_batch_plan", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 200")
def _(spark, sf):
    return engine(spark, sf, "events").query("LISTEN SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 200")


# --- components, versions, time travel ---


@query("component_signature_scan", f"WITH {LOG}, {LAST.format(t=5)}, {WIDE} SELECT entity, click, view, CAST({SIG} AS BIGINT) AS signature FROM w WHERE ({SIG} & 5) = 5")
def _(spark, sf):
    return wide(spark, sf, 5).where(temporal.has_all(F.col("signature"), 5)).select("entity", "click", "view", "signature")


@query("archetype_stats", f"WITH {LOG}, {LAST.format(t=5)}, {WIDE} SELECT CAST({SIG} AS BIGINT) AS signature, count(*) AS entities FROM w GROUP BY 1")
def _(spark, sf):
    return devtools.archetypes(wide(spark, sf, 5))


@query("explain_query", f"WITH {LOG}, {LAST.format(t=5)}, {WIDE}, a AS (SELECT {SIG} AS s, count(*) AS n FROM w WHERE ({SIG} & 1) = 1 GROUP BY 1) SELECT count(*) AS archetypes, CAST(coalesce(sum(n), 0) AS BIGINT) AS entities, CAST(count(*) FILTER (n BETWEEN 1 AND 3) AS BIGINT) AS sparse, CAST(coalesce(sum(n), 0) * count(*) AS BIGINT) AS cost, coalesce(sum(n), 0) = 0 OR count(*) > 4 OR sum(n) * count(*) > 10000 AS slow FROM a")
def _(spark, sf):
    return devtools.explain(wide(spark, sf, 5), 1)


@query("changed_since", f"WITH {LOG} SELECT entity, max(tick) AS tick FROM log WHERE comp = 'purchase' GROUP BY entity HAVING max(tick) > 700")
def _(spark, sf):
    state = temporal.as_of(log(spark, sf).where("comp = 'purchase'"), None)
    return temporal.changed_since(state, 700).select("entity", "tick")


@query("changed_in_query", f"WITH {LOG}, {LAST.format(t=719)}, {WIDE} SELECT w.entity, l.tick FROM w JOIN last l ON w.entity = l.entity AND l.comp = 'click' WHERE ({SIG} & 7) = 7 AND l.tick > 690")
def _(spark, sf):
    full = wide(spark, sf, 719).where(temporal.has_all(F.col("signature"), 7)).select("entity")
    changed = temporal.changed_since(temporal.as_of(log(spark, sf).where("comp = 'click'"), 719), 690)
    return changed.join(full, "entity", "left_semi").select("entity", "tick")


@query("as_of_tick", f"WITH {LOG}, {LAST.format(t=360)} SELECT entity, comp, value, tick FROM last")
def _(spark, sf):
    return temporal.as_of(log(spark, sf), 360).select("entity", "comp", "value", "tick")


@query("scrub_series", f"WITH {LOG}, k AS (SELECT DISTINCT entity, comp FROM log WHERE comp = 'purchase' AND tick <= 600), t AS (SELECT CAST(unnest(generate_series(0, 600, 60)) AS BIGINT) AS tick) SELECT k.entity, k.comp, t.tick, (SELECT arg_max(l.value, (l.tick, l.seq)) FROM log l WHERE l.entity = k.entity AND l.comp = k.comp AND l.tick <= t.tick) AS value FROM k, t")
def _(spark, sf):
    return temporal.scrub(log(spark, sf).where("comp = 'purchase'"), 0, 600, 60)


@query("dirty_set", f"WITH {LOG} SELECT DISTINCT entity, comp FROM log WHERE tick > 700 AND tick <= 710")
def _(spark, sf):
    return temporal.dirty(log(spark, sf), 700, 710)


@query("last_write_tick", f"WITH {LOG} SELECT entity, comp, max(tick) AS last_tick FROM log GROUP BY entity, comp")
def _(spark, sf):
    return temporal.last_write(log(spark, sf))


@query("previous_value", f"WITH {LOG} SELECT entity, comp, tick, seq, value, lag(value) OVER (PARTITION BY entity, comp ORDER BY tick, seq) AS old FROM log WHERE comp = 'purchase'")
def _(spark, sf):
    return temporal.previous(log(spark, sf).where("comp = 'purchase'")).select("entity", "comp", "tick", "seq", "value", "old")


@query("live_entities", f"WITH {LOG}, {LIFE} SELECT entity FROM life GROUP BY entity HAVING arg_max(spawned, (tick, seq))")
def _(spark, sf):
    return temporal.live(life(spark, sf)).select("entity")


BORN = "turns AS (SELECT *, coalesce(lag(spawned) OVER (PARTITION BY entity ORDER BY tick, seq), false) AS lived FROM {life}), live AS (SELECT entity, max((tick, seq)) FILTER (spawned AND NOT lived) AS born FROM turns GROUP BY entity HAVING arg_max(spawned, (tick, seq)))"
LIVING = f"{LOG}, {LIFE}, upto AS (SELECT * FROM life WHERE tick <= 500), {BORN.format(life='upto')}"


@query("living_state", f"WITH {LIVING}, {LAST.format(t=500)}, s AS (SELECT entity, comp, max((tick, seq)) AS at FROM log WHERE tick <= 500 GROUP BY ALL) SELECT last.entity, last.comp, last.value FROM last JOIN live ON last.entity = live.entity JOIN s ON s.entity = last.entity AND s.comp = last.comp WHERE s.at > live.born")
def _(spark, sf):
    return temporal.living_state(log(spark, sf), life(spark, sf), 500).select("entity", "comp", "value")


@query("rollback_to", f"WITH {LOG} SELECT entity, comp, arg_max(value, (tick, seq)) AS value FROM log WHERE tick <= 300 GROUP BY entity, comp")
def _(spark, sf):
    return temporal.as_of(temporal.rollback(log(spark, sf), 300), None).select("entity", "comp", "value")


@query("resimulate_inputs", f"WITH {LOG}, i AS (SELECT tick, seq + 1099511627776 AS seq, entity, comp, value * 2 AS value FROM log WHERE seq % 50 = 0 AND tick > 100 AND tick <= 400), r AS (SELECT * FROM log WHERE tick <= 400 UNION ALL SELECT * FROM i) SELECT entity, comp, arg_max(value, (tick, seq)) AS value FROM r GROUP BY entity, comp")
def _(spark, sf):
    rows = log(spark, sf)
    inputs = rows.where("seq % 50 = 0").withColumn("value", F.col("value") * 2)
    return temporal.as_of(temporal.resimulated(rows, inputs, 100, 400), None).select("entity", "comp", "value")


@query("history_pruned", f"WITH {LOG}, base AS (SELECT arg_max(tick, (tick, seq)) AS tick, arg_max(seq, (tick, seq)) AS seq, entity, comp, arg_max(value, (tick, seq)) AS value FROM log WHERE tick <= 119 GROUP BY entity, comp) SELECT * FROM base UNION ALL SELECT * FROM log WHERE tick > 119")
def _(spark, sf):
    return temporal.pruned(log(spark, sf), 719)


REPLICA = f"{LOG}, rep AS (SELECT tick, seq, entity, comp, CASE WHEN seq % 997 = 0 THEN value + 1 ELSE value END AS value FROM log)"


def replica(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.when(F.col("seq") % 997 == 0, F.col("value") + 1).otherwise(F.col("value")))


@query("divergence_first_tick", f"WITH {REPLICA} SELECT min(coalesce(a.tick, b.tick)) AS tick FROM log a FULL JOIN rep b USING (tick, seq, entity, comp) WHERE a.value IS DISTINCT FROM b.value")
def _(spark, sf):
    rows = log(spark, sf)
    return devtools.first_divergence(rows, replica(rows))


@query("first_state_difference", f"WITH {REPLICA} SELECT coalesce(min(a.tick), 720) AS tick FROM (SELECT entity, comp, tick, arg_max(value, seq) AS value FROM log GROUP BY ALL) a JOIN (SELECT entity, comp, tick, arg_max(value, seq) AS value FROM rep GROUP BY ALL) b USING (entity, comp, tick) WHERE a.value <> b.value")
def _(spark, sf):
    rows = log(spark, sf)
    return temporal.first_difference(rows, replica(rows), 0, 719)


@query("causal_previous_write", f"WITH {LOG} SELECT w.entity, w.seq, max((c.tick, c.seq))[2] AS cause FROM log w JOIN log c ON c.entity = w.entity AND c.comp = 'view' AND (c.tick, c.seq) < (w.tick, w.seq) WHERE w.comp = 'purchase' GROUP BY w.entity, w.seq")
def _(spark, sf):
    # the latest earlier write of the input by a running maximum, one sort an entity
    rows = log(spark, sf).where(F.col("comp").isin("purchase", "view"))
    before = Window.partitionBy("entity").orderBy("tick", "seq").rowsBetween(Window.unboundedPreceding, -1)
    cause = F.max(F.when(F.col("comp") == "view", F.struct("tick", "seq"))).over(before)
    return rows.withColumn("c", cause).where("comp = 'purchase' AND c IS NOT NULL").select("entity", "seq", F.col("c.seq").alias("cause"))


HASH = "bit_xor(CAST('0x' || left(md5({text}), 15) AS BIGINT))"


@query("state_checksum", f"WITH {LOG} SELECT comp, tick, count(*) AS n, {HASH.format(text="seq || '|' || entity")} AS hash FROM log GROUP BY comp, tick")
def _(spark, sf):
    return devtools.checksum(log(spark, sf), ["seq", "entity"], ["comp", "tick"], portable=True)


@query("state_hash", f"WITH {LOG} SELECT comp, count(*) AS n, {HASH.format(text="concat_ws('|', tick, seq, entity, comp, value)")} AS hash FROM log GROUP BY comp")
def _(spark, sf):
    return devtools.checksum(log(spark, sf), ["tick", "seq", "entity", "comp", "value"], ["comp"], portable=True)


INPUTS = "CASE comp WHEN 'purchase' THEN 'click' WHEN 'click' THEN 'view' END"


@query("causal_trace", f"WITH {REPLICA}, bad AS (SELECT tick, seq, entity, comp, {INPUTS} AS input FROM log WHERE seq % 7 = 0) SELECT b.tick, b.seq, b.entity, b.comp, (SELECT max((c.tick, c.seq)) FROM bad c WHERE c.entity = b.entity AND c.comp = b.input AND (c.tick, c.seq) < (b.tick, b.seq))[2] AS cause FROM bad b")
def _(spark, sf):
    rows = log(spark, sf).withColumns({"system": F.col("comp"), "input": F.expr(INPUTS)})
    other = rows.withColumn("value", F.when(F.col("seq") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return devtools.causes(rows, other).select("tick", "seq", "entity", "comp", F.col("from.seq").alias("cause"))


@query("session_audit", f"WITH {LOG} SELECT seq, entity, comp, value, lag(value) OVER (PARTITION BY entity, comp ORDER BY seq) AS old FROM log WHERE comp = 'error'")
def _(spark, sf):
    return schema.audit(log(spark, sf).where("comp = 'error'").drop("tick")).select("seq", "entity", "comp", "value", "old")


# --- change sets ---


EDGE_LOG = "elog AS (SELECT o_orderkey % 1000 AS tick, o_orderkey AS seq, o_custkey AS src, 0 AS kind, o_custkey % 97 AS dst, o_totalprice AS payload, o_orderstatus = 'F' AS gone FROM orders)"


def edge_log(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of customers, some of them removed, and added again, by later orders."""
    o = table(spark, sf, "orders")
    return o.select((F.col("o_orderkey") % 1000).alias("tick"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("src"), F.lit(0).alias("kind"), (F.col("o_custkey") % 97).alias("dst"), F.col("o_totalprice").alias("payload"), F.when(F.col("o_orderstatus") == "F", "remove").otherwise("add").alias("op"))


CAPTURED = "u AS (SELECT 'update' AS op, max(tick) AS tick, max((tick, seq))[2] AS seq, entity, comp, arg_max(value, (tick, seq)) AS value, CAST(NULL AS BIGINT) AS dst, CAST(NULL AS DOUBLE) AS payload FROM log WHERE tick > 600 GROUP BY entity, comp), r AS (SELECT src, kind, dst, max((tick, seq)) AS pt, arg_max(payload, (tick, seq)) AS payload, arg_max(gone, (tick, seq)) AS gone FROM elog WHERE tick > 600 GROUP BY ALL), delta AS (SELECT * FROM u UNION ALL SELECT CASE WHEN spawned THEN 'spawn' ELSE 'despawn' END, tick, seq, entity, NULL, NULL, NULL, NULL FROM life WHERE tick > 600 UNION ALL SELECT CASE WHEN gone THEN 'unrelate' ELSE 'relate' END, pt[1], pt[2], src, NULL, NULL, dst, payload FROM r)"


def captured(spark: SparkSession, sf: str) -> DataFrame:
    return delta.capture(log(spark, sf), life(spark, sf), edge_log(spark, sf), 600)


@query("delta_capture", f"WITH {LOG}, {LIFE}, {EDGE_LOG}, {CAPTURED} SELECT op, tick, entity, comp, value, dst, payload FROM delta")
def _(spark, sf):
    return captured(spark, sf).select("op", "tick", "entity", "comp", "value", "dst", "payload")


LATE = "late AS (SELECT 601 AS tick, seq, entity, spawned FROM life WHERE tick > 600)"


@query("delta_apply", f"WITH {LOG}, {LIFE}, {EDGE_LOG}, {CAPTURED}, {LATE}, {BORN.format(life='late')} SELECT d.entity, d.comp, d.value FROM delta d JOIN live ON d.entity = live.entity WHERE d.op = 'update' AND (601, d.seq) > live.born")
def _(spark, sf):
    from ..world import World

    return delta.applied(World.empty(spark), captured(spark, sf), 601).state().select("entity", "comp", "value")


@query("replay_state", f"WITH {LOG}, {LIFE}, {BORN.format(life='life')}, last AS (SELECT entity, comp, arg_max(value, (tick, seq)) AS value, max((tick, seq)) AS at FROM log GROUP BY entity, comp) SELECT last.entity, last.comp, last.value FROM last JOIN live ON last.entity = live.entity WHERE last.at > live.born")
def _(spark, sf):
    from ..world import World

    writes = delta.shaped(log(spark, sf), F.lit("update"))
    births = delta.shaped(life(spark, sf), F.when(F.col("spawned"), "spawn").otherwise("despawn"))
    ticks = writes.unionByName(births).withColumn("end_tick", F.col("tick"))
    return delta.applied_ticks(World.empty(spark), ticks, 719).state().select("entity", "comp", "value")


ADDED = "log2 AS (SELECT * FROM log UNION ALL VALUES (800, 9000000001, 100001, 'click', 7.5), (800, 9000000002, 3, 'view', 1.25), (800, 9000000003, 100002, 'view', 2.5)), life2 AS (SELECT * FROM life UNION ALL VALUES (800, 9000000000, 100001, true), (800, 9000000004, 5, false), (800, 9000000005, 100001, true))"


@query("world_writes", f"WITH {LOG}, {LIFE}, {ADDED}, {BORN.format(life='life2')}, last AS (SELECT entity, comp, arg_max(value, (tick, seq)) AS value, max((tick, seq)) AS at FROM log2 GROUP BY entity, comp) SELECT last.entity, last.comp, last.value FROM last JOIN live ON last.entity = live.entity WHERE last.at > live.born")
def _(spark, sf):
    from ..world import World

    w = World(log(spark, sf), life(spark, sf), edge_log(spark, sf), 800, 9_000_000_000)
    w = w.spawn(100_001).write((100_001, "click", 7.5), (3, "view", 1.25), (100_002, "view", 2.5)).despawn(5).spawn(100_001)
    return w.state().select("entity", "comp", "value")


@query("despawn_cleans_edges", f"WITH {EDGE_LOG}, gone AS (SELECT c_custkey AS entity FROM customer WHERE c_nationkey % 5 = 3), e AS (SELECT src, kind, dst, arg_max(payload, (tick, seq)) AS payload, arg_max(gone, (tick, seq)) AS gone FROM elog GROUP BY src, kind, dst) SELECT src, kind, dst, payload FROM e WHERE NOT gone AND src IN (SELECT c_custkey FROM customer) AND dst IN (SELECT c_custkey FROM customer) AND src NOT IN (SELECT entity FROM gone) AND dst NOT IN (SELECT entity FROM gone)")
def _(spark, sf):
    c = table(spark, sf, "customer")
    born = c.select(F.lit(-1).cast("long").alias("tick"), F.lit(0).cast("long").alias("seq"), F.col("c_custkey").alias("entity"), F.lit(None).cast("string").alias("prefab"), F.lit(True).alias("spawned"))
    died = born.join(c.where("c_nationkey % 5 = 3").select(F.col("c_custkey").alias("entity")), "entity", "left_semi").select(F.lit(1001).cast("long").alias("tick"), "seq", "entity", "prefab", F.lit(False).alias("spawned"))
    return graph.current(edge_log(spark, sf), temporal.live(born.unionByName(died))).select("src", "kind", "dst", "payload")


@query("relation_changed_sources", f"WITH {EDGE_LOG} SELECT src, max(tick) AS tick FROM elog WHERE NOT gone AND tick > 700 GROUP BY src")
def _(spark, sf):
    return graph.changed_sources(edge_log(spark, sf), 0, 700)


@query("relation_log_pruned", f"WITH {EDGE_LOG}, l AS (SELECT src, kind, dst, arg_max(gone, (tick, seq)) AS gone, max(tick) AS tick FROM elog GROUP BY src, kind, dst) SELECT elog.tick, elog.seq, elog.src, elog.dst FROM elog JOIN l ON elog.src = l.src AND elog.kind = l.kind AND elog.dst = l.dst WHERE NOT (l.gone AND l.tick <= 500)")
def _(spark, sf):
    return graph.pruned(edge_log(spark, sf), 500).select("tick", "seq", "src", "dst")


FOLD = f"{LOG}, d AS (SELECT CASE WHEN comp = 'signup' THEN 'spawn' WHEN comp = 'error' THEN 'despawn' ELSE 'update' END AS op, tick, seq, entity, comp, value FROM log), l AS (SELECT entity, max((tick, seq)) FILTER (op = 'despawn') AS died, max((tick, seq)) FILTER (op <> 'despawn') AS acted FROM d GROUP BY entity), k AS (SELECT d.* FROM d JOIN l ON d.entity = l.entity WHERE op <> 'despawn' AND (died IS NULL OR (d.tick, d.seq) > died))"


@query("fold_last_write_wins", f"WITH {FOLD} SELECT 'update' AS op, entity, comp, arg_max(value, (tick, seq)) AS value FROM k WHERE op = 'update' GROUP BY entity, comp UNION ALL SELECT DISTINCT 'spawn', entity, NULL, NULL FROM k")
def _(spark, sf):
    op = F.when(F.col("comp") == "signup", "spawn").when(F.col("comp") == "error", "despawn").otherwise("update")
    return delta.fold(delta.shaped(log(spark, sf), op)).select("op", "entity", "comp", "value")


@query("codec_quantized_floats", "SELECT vec_id, round(max(abs(v)) / 32767, 12) AS scale, CAST(sum(abs(round(v / (max_v / 32767)))) AS BIGINT) AS total FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, list_max([abs(CAST(x AS DOUBLE)) FOR x IN embedding]) AS max_v FROM embeddings) GROUP BY vec_id")
def _(spark, sf):
    packed = table(spark, sf, "embeddings").select("vec_id", delta.quantize_floats(F.col("embedding")).alias("p"))
    total = F.aggregate("p.q", F.lit(0).cast("long"), lambda a, x: a + F.abs(x.cast("long")))
    return packed.select("vec_id", F.round("p.scale", 12).alias("scale"), total.alias("total"))


@query("codec_run_lengths", f"WITH {LOG}, a AS (SELECT entity, seq, comp, row_number() OVER (PARTITION BY entity ORDER BY seq) - row_number() OVER (PARTITION BY entity, comp ORDER BY seq) AS grp FROM log) SELECT entity, comp, min(seq) AS first, max(seq) AS last, count(*) AS length FROM a GROUP BY entity, comp, grp")
def _(spark, sf):
    return devtools.run_lengths(log(spark, sf), ["entity"], "seq", "comp")


@query("wal_recovery", "WITH w AS (SELECT event_id AS lsn, user_id % 7 AS txn, event_id % 50 AS page, user_id AS slot, value FROM events), c AS (SELECT DISTINCT user_id % 7 AS txn FROM events WHERE event_type = 'signup' AND user_id % 7 < 4) SELECT page, slot, arg_max(value, lsn) AS value, max(lsn) AS lsn FROM w WHERE txn = 0 OR txn IN (SELECT txn FROM c) GROUP BY page, slot")
def _(spark, sf):
    e = table(spark, sf, "events")
    txn = F.col("user_id") % 7
    writes = e.select(F.col("event_id").alias("lsn"), txn.alias("txn"), F.lit("write").alias("op"), (F.col("event_id") % 50).alias("page"), F.col("user_id").alias("offset"), F.col("value").alias("data"))
    commits = e.where((F.col("event_type") == "signup") & (txn < 4)).select(F.col("event_id").alias("lsn"), txn.alias("txn"), F.lit("commit").alias("op"), F.lit(None).cast("long").alias("page"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("double").alias("data"))
    return schema.recovered(writes.unionByName(commits)).select("page", F.col("offset").alias("slot"), F.col("data").alias("value"), "lsn")


# --- relations ---


@query("relation_out", f"WITH {ORDER_EDGES} SELECT src, kind, dst, payload FROM edges WHERE src IN (SELECT o_orderkey FROM orders)")
def _(spark, sf):
    return graph.outgoing(order_edges(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity")).distinct(), 0)


@query("neighbour_lists", "WITH n AS (SELECT o_custkey AS src, o_orderkey AS dst, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8 AS page FROM orders) SELECT src, page, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS dsts FROM n GROUP BY src, page")
def _(spark, sf):
    ties = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.lit(0).alias("kind"), F.col("o_orderkey").alias("dst"))
    return graph.neighbours(ties, 8).select("src", "page", F.array_join(F.col("dsts").cast("array<string>"), ",").alias("dsts"))


@query("relation_in", f"WITH {ORDER_EDGES} SELECT src, kind, dst, payload FROM edges WHERE dst IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
def _(spark, sf):
    who = table(spark, sf, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("entity"))
    return graph.incoming(order_edges(spark, sf), who, 0)


@query("relation_degree", f"WITH {ORDER_EDGES} SELECT dst AS entity, kind, count(*) AS degree FROM edges GROUP BY dst, kind")
def _(spark, sf):
    return graph.degrees(order_edges(spark, sf), "dst")


@query("has_relation", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(spark, sf):
    ties = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return graph.related(table(spark, sf, "customer").select("c_custkey"), ties, ["c_custkey"], negate=True)


@query("relation_tombstones", "WITH d AS (SELECT o_orderkey AS src, o_custkey AS dst, o_orderstatus AS s, o_orderkey % 1000 AS tick FROM orders) SELECT src, dst, tick FROM d WHERE s = 'F' AND tick > 500")
def _(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select((F.col("o_orderkey") % 1000).alias("tick"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("src"), F.lit(0).alias("kind"), F.col("o_custkey").alias("dst"), F.col("o_totalprice").alias("payload"), F.when(F.col("o_orderstatus") == "F", "remove").otherwise("add").alias("op"))
    return graph.removed_since(rows, 500).select("src", "dst", "tick")


@query("recursive_hierarchy", "WITH RECURSIVE e AS (SELECT 1000 + r_regionkey AS src, 2000 + n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 2000 + s_nationkey, 3000 + s_suppkey FROM supplier), w AS (SELECT 1001 AS entity, 0 AS hops UNION ALL SELECT e.dst, w.hops + 1 FROM w JOIN e ON w.entity = e.src WHERE w.hops < 3) SELECT CAST(entity AS BIGINT) AS entity, CAST(min(hops) AS BIGINT) AS hops FROM w GROUP BY entity")
def _(spark, sf):
    a = table(spark, sf, "nation").select((F.col("n_regionkey") + 1000).cast("long").alias("src"), (F.col("n_nationkey") + 2000).cast("long").alias("dst"))
    b = table(spark, sf, "supplier").select((F.col("s_nationkey") + 2000).cast("long").alias("src"), (F.col("s_suppkey") + 3000).cast("long").alias("dst"))
    return graph.reachable(a.unionByName(b), spark.createDataFrame([(1001,)], "entity long"), 3)


# --- space ---


@query("range_box", f"WITH {ITEMS} SELECT entity, x, y, z FROM items WHERE x BETWEEN 18 AND 22 AND y BETWEEN 28 AND 32 AND z BETWEEN 3 AND 7")
def _(spark, sf):
    return spatial.in_range(items(spark, sf), (20, 30, 5), 2)


@query("range_sphere", f"WITH {ITEMS} SELECT entity FROM items WHERE (x-20)*(x-20)+(y-30)*(y-30)+(z-5)*(z-5) <= 4.0")
def _(spark, sf):
    return spatial.in_range(items(spark, sf), (20, 30, 5), 2, exact=True).select("entity")


@query("grid_candidates", f"WITH {ITEMS} SELECT entity, CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy FROM items WHERE floor(x / 5) BETWEEN 3 AND 4 AND floor(y / 5) BETWEEN 5 AND 6 AND floor(z / 5) BETWEEN 0 AND 1")
def _(spark, sf):
    return spatial.grid_candidates(items(spark, sf), (20, 30, 5), 2, 5.0).select("entity", "cx", "cy")


@query("distance_join", f"WITH {POS} SELECT a.entity AS a, b.entity AS b FROM pos a JOIN pos b ON a.entity < b.entity AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.0025")
def _(spark, sf):
    return spatial.neighbour_pairs(positions(spark, sf), 0.05).select("a", "b")


@query("sector_range", f"WITH {ITEMS}, w AS (SELECT entity, x * 100 AS x, y * 100 AS y, z * 100 AS z FROM items) SELECT entity, CAST(floor((x + 512) / 1024) AS INT) AS sx, round(x - floor((x + 512) / 1024) * 1024, 6) AS ox FROM w WHERE (x-2000)*(x-2000)+(y-3000)*(y-3000)+(z-500)*(z-500) <= 90000")
def _(spark, sf):
    w = items(spark, sf).select("entity", g.sector_of(*(F.col(n) * 100 for n in "xyz")).alias("p"))
    return spatial.sector_range(w, (2000, 3000, 500), 300).select("entity", F.col("p.sx").alias("sx"), F.round("p.ox", 6).alias("ox"))


RAY = "(x+1)*1.0"


@query("raycast_nearest", f"WITH {POS}, h AS (SELECT entity, {RAY} AS l, (x+1)*(x+1)+y*y+z*z - ({RAY})*({RAY}) AS off FROM pos) SELECT entity, round(l - sqrt(0.0025 - off), 9) AS distance FROM h WHERE l >= 0 AND off <= 0.0025 AND l - sqrt(0.0025 - off) >= 0 ORDER BY l - sqrt(0.0025 - off), entity LIMIT 1")
def _(spark, sf):
    hit = spatial.raycast(positions(spark, sf), (-1, 0, 0), (2, 0, 0), 0.05)
    return hit.select("entity", F.round("distance", 9).alias("distance"))


@query("volume_as_of", f"WITH {LOG}, {LAST.format(t=200)}, p AS (SELECT entity, max(CASE WHEN comp = 'click' THEN value END) AS x, max(CASE WHEN comp = 'view' THEN value END) AS y FROM last GROUP BY entity) SELECT entity FROM p WHERE (x-200)*(x-200)+(y-200)*(y-200) <= 22500")
def _(spark, sf):
    p = wide(spark, sf, 200).select("entity", F.col("click").alias("x"), F.col("view").alias("y"), F.lit(0.0).alias("z"))
    return spatial.in_volume(p, g.Volume("sphere", (200, 200, 0), 150)).select("entity")


@query("frustum_volume", f"WITH {POS} SELECT entity FROM pos WHERE -(z-0.3) BETWEEN 0.05 AND 2 AND abs(x) <= tan(0.5) * -(z-0.3) AND abs(y) <= tan(0.25) * -(z-0.3)")
def _(spark, sf):
    v = g.Volume("frustum", (0.0, 0.0, 0.3), near=0.05, far=2.0, hfov=1.0, vfov=0.5)
    return positions(spark, sf).where(v.contains([F.col(n) for n in "xyz"])).select("entity")


# --- interest ---

SUBS = "subs AS (SELECT label AS sub, arg_min(x, entity) AS cx, arg_min(y, entity) AS cy, arg_min(z, entity) AS cz FROM pos GROUP BY label)"


def subscriptions(p: DataFrame, r: float) -> DataFrame:
    first = F.min_by(F.struct("x", "y", "z"), "entity").alias("c")
    return p.groupBy(F.col("label").alias("sub")).agg(first).select("sub", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"), F.lit(r).alias("r"))


@query("subscriptions_inside", f"WITH {POS}, {SUBS} SELECT sub, entity FROM subs JOIN pos ON (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz) <= 0.0225")
def _(spark, sf):
    p = positions(spark, sf)
    return interest.inside(p, subscriptions(p, 0.15)).select("sub", "entity")


@query("enter_leave", f"WITH {LOG}, s AS (SELECT entity, tick, seq, value > 250 AS inside FROM log WHERE comp = 'click'), e AS (SELECT *, coalesce(lag(inside) OVER (PARTITION BY entity ORDER BY tick, seq), false) AS before FROM s) SELECT entity, seq, CASE WHEN inside THEN 'enter' ELSE 'leave' END AS event FROM e WHERE inside <> before")
def _(spark, sf):
    s = log(spark, sf).where("comp = 'click'").select("entity", F.struct("tick", "seq").alias("at"), (F.col("value") > 250).alias("inside"))
    return interest.edges(s, ["entity"], "inside", "at").select("entity", F.col("at.seq").alias("seq"), "event")


@query("replication_diff", f"WITH {POS}, {SUBS}, d AS (SELECT sub, entity, (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz) AS q FROM subs JOIN pos ON true), o AS (SELECT sub, entity FROM d WHERE q <= 0.01), n AS (SELECT sub, entity FROM d WHERE q <= 0.0225 AND entity % 2 = 0) SELECT sub, entity, 'enter' AS event FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT sub, entity, 'leave' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)")
def _(spark, sf):
    p = positions(spark, sf)
    old = interest.inside(p, subscriptions(p, 0.1))
    new = interest.inside(p.where("entity % 2 = 0"), subscriptions(p, 0.15))
    return interest.difference(old, new)


LOD = [(0.1, 1, 0.0), (0.2, 2, 0.05), (0.3, 4, 0.1)]


@query("subscriber_delta_lod", f"WITH {POS}, {SUBS}, d AS (SELECT sub, entity, x, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) AS d FROM subs JOIN pos ON (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz) <= 0.16) SELECT sub, entity, CASE WHEN d <= 0.1 THEN 0 WHEN d <= 0.2 THEN 1 ELSE 2 END AS tier, round(CASE WHEN d <= 0.1 THEN x WHEN d <= 0.2 THEN round(x / 0.05) * 0.05 ELSE round(x / 0.1) * 0.1 END, 6) + 0.0 AS x FROM d WHERE d <= 0.3")
def _(spark, sf):
    p = positions(spark, sf)
    rows = interest.level_rows(interest.inside(p, subscriptions(p, 0.4)), LOD).where("tier is not null").join(p.select("entity", "x"), "entity")
    return rows.select("sub", "entity", "tier", (F.round(num.quantized(F.col("x"), F.col("step")), 6) + 0.0).alias("x"))


@query("subscriber_delta", f"WITH {POS}, {SUBS}, d AS (SELECT sub, entity, x, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) AS d, (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz) AS q FROM subs JOIN pos ON true) SELECT sub, entity, 'spawn' AS op, NULL AS comp, NULL AS value FROM d WHERE q <= 0.3*0.3 AND NOT q <= 0.2*0.2 UNION ALL SELECT sub, entity, 'update', 'x', round(CASE WHEN d <= 0.1 THEN x WHEN d <= 0.2 THEN round(x / 0.05) * 0.05 ELSE round(x / 0.1) * 0.1 END, 6) + 0.0 FROM d WHERE q <= 0.3*0.3 AND d <= 0.3")
def _(spark, sf):
    p = positions(spark, sf)
    now, known = interest.inside(p, subscriptions(p, 0.3)), interest.inside(p, subscriptions(p, 0.2))
    values = p.select("entity", F.lit("x").alias("comp"), F.col("x").alias("value"), F.lit(1).cast("long").alias("tick"))
    return interest.subscriber_delta(now, known, values, LOD, 0).withColumn("value", F.round("value", 6) + 0.0)


@query("lod_rate_limit", f"WITH RECURSIVE {LOG}, v AS (SELECT DISTINCT entity, tick FROM log WHERE comp = 'view' AND tick > 0), n AS (SELECT a.entity, a.tick, min(b.tick) AS later FROM v a JOIN v b ON a.entity = b.entity AND b.tick >= a.tick + 12 GROUP BY a.entity, a.tick), s AS (SELECT entity, min(tick) AS tick FROM v GROUP BY entity UNION ALL SELECT n.entity, n.later FROM s JOIN n ON s.entity = n.entity AND s.tick = n.tick) SELECT CAST(1 AS BIGINT) AS sub, entity, 'view' AS comp, 0 AS tier, tick, tick AS last_write, 12 AS every FROM s")
def _(spark, sf):
    rows = log(spark, sf).where("comp = 'view'").select(F.lit(1).cast("long").alias("sub"), "entity", "comp", F.lit(0).alias("tier"), "tick", F.col("tick").alias("last_write"), F.lit(12).alias("every"))
    return interest.send_times(rows.groupBy("sub", "entity", "comp", "tier", "tick", "last_write", "every").count().drop("count"))


@query("vision_cone", f"WITH {POS} SELECT o.entity AS observer, t.entity AS target FROM pos o JOIN pos t ON o.entity <> t.entity AND (t.x-o.x)*(t.x-o.x)+(t.y-o.y)*(t.y-o.y)+(t.z-o.z)*(t.z-o.z) <= 0.01 AND (t.x-o.x) >= 0.8 * sqrt((t.x-o.x)*(t.x-o.x)+(t.y-o.y)*(t.y-o.y)+(t.z-o.z)*(t.z-o.z)) WHERE o.label = 3")
def _(spark, sf):
    p = positions(spark, sf)
    o = p.where("label = 3").select("entity", "x", "y", "z", F.lit(1.0).alias("fx"), F.lit(0.0).alias("fy"), F.lit(0.0).alias("fz"), F.lit(0.1).alias("range"), F.lit(0.8).alias("cos_half"))
    return interest.visible(o, p, 0.1).select("observer", "target")


@query("perception_events", f"WITH {LOG}, s AS (SELECT entity, tick, seq, value BETWEEN 100 AND 300 AS seen FROM log WHERE comp = 'view'), e AS (SELECT *, coalesce(lag(seen) OVER (PARTITION BY entity ORDER BY tick, seq), false) AS b FROM s) SELECT entity, seq, CASE WHEN seen THEN 'SPOTTED' ELSE 'LOST' END AS event FROM e WHERE seen <> b")
def _(spark, sf):
    s = log(spark, sf).where("comp = 'view'").select("entity", F.struct("tick", "seq").alias("at"), F.col("value").between(100, 300).alias("seen"))
    return interest.edges(s, ["entity"], "seen", "at", ("SPOTTED", "LOST")).select("entity", F.col("at.seq").alias("seq"), "event")


@query("hearing", f"WITH {POS} SELECT o.entity AS observer, s.entity AS sound FROM pos o JOIN pos s ON (s.x-o.x)*(s.x-o.x)+(s.y-o.y)*(s.y-o.y)+(s.z-o.z)*(s.z-o.z) <= 0.0064 WHERE o.label = 1 AND s.label = 2")
def _(spark, sf):
    p = positions(spark, sf)
    ears = p.where("label = 1").select("entity", "x", "y", "z", F.lit(0.04).alias("radius"))
    sounds = p.where("label = 2").select(F.col("entity").alias("sound"), "x", "y", "z", F.lit(2.0).alias("loudness"))
    return interest.heard(ears, sounds, 0.08)


@query("chunk_priority_topk", "WITH c AS (SELECT DISTINCT CAST(l_quantity AS INT) % 9 - 4 AS cx, l_linenumber - 3 AS cy, 0 AS cz FROM lineitem), d AS (SELECT *, sqrt((cx*1024.0-100)*(cx*1024.0-100)+cy*1024.0*cy*1024.0) AS d, sqrt((cx*1024.0-1300)*(cx*1024.0-1300)+cy*1024.0*cy*1024.0) AS p FROM c), s AS (SELECT *, greatest(CASE WHEN d < 1500 THEN 1500 - d ELSE 0 END + (3000 - p) * 0.5, 0) AS priority FROM d WHERE d <= 1500 OR p <= 1500) SELECT cx, cy, round(priority, 6) AS priority FROM s ORDER BY priority DESC, cx, cy LIMIT 5")
def _(spark, sf):
    c = table(spark, sf, "lineitem").select((F.col("l_quantity").cast("int") % 9 - 4).alias("cx"), (F.col("l_linenumber") - 3).alias("cy"), F.lit(0).alias("cz"), F.lit("DORMANT").alias("state")).distinct()
    plan = interest.chunk_plan(c, {"x": 100.0, "y": 0.0, "z": 0.0, "vx": 600.0}, load=1500.0, prefetch=3000.0, budget=5)
    return plan.where("action = 'load'").select("cx", "cy", F.round("priority", 6).alias("priority"))


# --- agents, navigation, generation, numbers ---

UTILITY = "CASE WHEN n_chars <= 0 THEN 0.0 WHEN n_chars <= 1000 THEN n_chars * (0.5/1000) WHEN n_chars <= 5000 THEN 0.5 + (n_chars - 1000) * (0.5/4000) ELSE 1.0 END"


@query("utility_score", f"SELECT d.doc_id, round({UTILITY} * 1.0 + coalesce(CASE WHEN quality <= 0 THEN 0.2 WHEN quality <= 1 THEN 0.2 + quality * 0.8 ELSE 1.0 END * 0.5, 0), 6) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    curves = {"n": ([(0, 0), (1000, 0.5), (5000, 1)], 1.0), "q": ([(0, 0.2), (1, 1)], 0.5)}
    return d.select("doc_id", F.round(num.utility({"n": F.col("n_chars"), "q": F.col("quality")}, curves), 6).alias("score"))


@query("behaviour_tree", "SELECT c_custkey, CASE WHEN c_acctbal >= 1000 AND c_nationkey < 10 THEN 'SUCCESS' WHEN c_acctbal < 0 THEN 'RUNNING' ELSE 'FAILURE' END AS status FROM customer")
def _(spark, sf):
    from ..operators.agents import Node

    leaf = lambda name: Node("leaf", leaf=name)
    tree = Node("selector", (Node("sequence", (leaf("rich"), leaf("near"))), leaf("flee"))).check()
    yes = lambda test, other="FAILURE": F.when(test, "SUCCESS").otherwise(other)
    leaves = {"rich": yes(F.col("c_acctbal") >= 1000), "near": yes(F.col("c_nationkey") < 10), "flee": F.when(F.col("c_acctbal") < 0, "RUNNING").otherwise("FAILURE")}
    return table(spark, sf, "customer").select("c_custkey", tree.status(leaves).alias("status"))


@query("goal_plans", "SELECT c_custkey, CAST(c_acctbal > 0 AS DOUBLE) AS gold, CASE WHEN c_acctbal > 0 THEN '2' ELSE '1,2' END AS plan FROM customer WHERE c_acctbal IS NOT NULL")
def _(spark, sf):
    from ..operators.agents import Action, plans

    c = table(spark, sf, "customer").where("c_acctbal is not null").select("c_custkey", (F.col("c_acctbal") > 0).cast("double").alias("gold"))
    found = plans(c, ["gold"], {"house": 1.0}, [Action(1, "gold", 1.0), Action(2, "house", 1.0, "gold", 1.0)])
    return found.withColumn("plan", F.array_join(F.col("plan").cast("array<string>"), ","))


@query("obstacle_patch", "WITH n AS (SELECT p_partkey AS node, p_size % 10 AS cx FROM part), a AS (SELECT node FROM n WHERE cx BETWEEN 2 AND 3) SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey IN (SELECT node FROM a) OR l_suppkey IN (SELECT node FROM a)")
def _(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 10).alias("cx"), F.lit(0).alias("cy"), F.lit(0).alias("cz"), F.lit(False).alias("blocked"))
    ties = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return nav.obstacle_patch(nodes, ties, (2, 0, 0), (3, 0, 0), True)[1]


@query("path_samples", "WITH r AS (SELECT o_orderkey AS route, CAST(o_custkey % 3000 AS DOUBLE) AS x1 FROM orders), s AS (SELECT route, x1, CAST(CASE WHEN x1 <= 64 THEN 0 ELSE floor(x1 / 64) END AS INT) AS n FROM r), p AS (SELECT route, unnest(range(0, n + 2)) AS i, n, x1 FROM s), q AS (SELECT route, i, CASE WHEN i > n THEN x1 ELSE x1 * (i / greatest(n, 1)) END AS x FROM p) SELECT route, CAST(i AS INT) AS i, round(x, 6) AS x FROM q WHERE i > 0 AND route NOT IN (SELECT route FROM q WHERE floor(x / 1024) >= 2)")
def _(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("route"), *(F.lit(0.0).alias(n) for n in ("x0", "y0", "z0")), (F.col("o_custkey") % 3000).cast("double").alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.0).alias("z1"))
    resident = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "tx long, ty long, tz long")
    return nav.straight_paths(r, resident)[0].select("route", "i", F.round("x", 6).alias("x"))


@query("lane_best", "WITH l AS (SELECT CAST(floor(c_custkey / 8) AS BIGINT) AS lane, sum(c_acctbal + c_nationkey) AS total FROM customer GROUP BY 1) SELECT lane, round(total, 4) AS total FROM l ORDER BY total DESC, lane LIMIT 1")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("row"), "c_acctbal", "c_nationkey")
    return nav.lane_best(c, "c_acctbal", "c_nationkey").select("lane", F.round("total", 4).alias("total"))


@query("procedural_sectors")
def _(spark, sf):
    s = table(spark, sf, "nation").select(F.lit(42).cast("long").alias("world"), F.col("n_nationkey").cast("long").alias("sx"), F.col("n_regionkey").cast("long").alias("sy"), F.lit(0).cast("long").alias("sz"))
    return nav.readback(nav.generate_sectors(s, 16, (0, 0, 0), (1024, 1024, 64)), 1)


@query("fixed_point", "WITH f AS (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity * 65536) AS BIGINT) AS a, CAST(trunc(l_discount * 65536) AS BIGINT) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, (a * b + 32768) >> 16 AS product, CASE WHEN b = 0 THEN 2147483647 ELSE (a << 16) // b END AS quotient FROM f")
def _(spark, sf):
    a, b = num.fix(F.col("l_quantity")), num.fix(F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", num.fix_mul(a, b).alias("product"), num.fix_div(a, b).alias("quotient"))


@query("kernel_ops", "SELECT p_partkey, round(least(greatest(((p_retailprice + 10) * 0.5) + (1000 - ((p_retailprice + 10) * 0.5)) * 0.25, 300), 900) * 2, 6) AS v FROM part")
def _(spark, sf):
    ops = [("add", 10), ("mul", 0.5), ("lerp", 1000, 0.25), ("clamp", 300, 900), ("scale", 2)]
    return table(spark, sf, "part").select("p_partkey", F.round(num.kernel(F.col("p_retailprice"), ops), 6).alias("v"))


# --- schemas, tiers, diagnostics ---


@query("migrated_schema", "SELECT c_custkey, c_acctbal AS hp, 100.0 AS max_hp FROM customer WHERE c_acctbal IS NOT NULL")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("hp")).alias("health"))
    new = schema.upgrade(c, "health", [schema.Rule(1, 2, {"hp": "hp", "max_hp": F.lit(100.0)})], 1, 2)
    return new.select("c_custkey", "health.hp", "health.max_hp")


@query("sandbox_projection", "SELECT c_custkey AS entity, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL")
def _(spark, sf):
    return schema.Sandbox(table(spark, sf, "customer").withColumnRenamed("c_custkey", "entity"), frozenset({"c_acctbal"})).query("c_acctbal")


@query("tier_reclassify", f"WITH {LOG}, n AS (SELECT comp, count(*) / 100.0 AS accesses FROM log GROUP BY comp) SELECT comp, CASE WHEN accesses >= 20 THEN 'HOT' WHEN accesses <= 5 THEN 'COLD' ELSE 'WARM' END AS tier FROM n")
def _(spark, sf):
    n = log(spark, sf).groupBy("comp").agg((F.count("*") / 100).alias("accesses"))
    return devtools.tiers(n, 20, 5).select("comp", "tier")


@query("occupancy", f"WITH {LOG}, {LAST.format(t=5)}, {WIDE}, a AS (SELECT CAST({SIG} AS BIGINT) AS signature, count(*) AS n FROM w GROUP BY 1) SELECT signature, round(CASE WHEN n % 256 = 0 THEN 1.0 ELSE (floor(n / 256) + (n % 256) / 256.0) / (floor(n / 256) + 1) END, 9) AS occupancy FROM a")
def _(spark, sf):
    return devtools.archetypes(wide(spark, sf, 5)).select("signature", F.round(devtools.occupancy(F.col("entities")), 9).alias("occupancy"))


@query("dirty_pages", "SELECT count(DISTINCT o_orderkey // 256) AS pages, count(DISTINCT o_orderkey // 256) * 256 * 12 AS bytes FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf):
    return devtools.dirty_pages(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("row")), 12)


@query("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    from ..streaming import live

    out = live.windowed(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 day", keys=("event_type",))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# --- further operators over whole tables ---


@query("raycast_each", f"WITH {POS}, rays AS (SELECT entity AS ray, -1.0 AS ox, y AS oy, z AS oz FROM pos WHERE label = 4), h AS (SELECT ray, entity, (x - ox) AS l, (y-oy)*(y-oy)+(z-oz)*(z-oz) AS off FROM rays JOIN pos ON (y-oy)*(y-oy)+(z-oz)*(z-oz) <= 0.0025), k AS (SELECT ray, entity, l - sqrt(0.0025 - off) AS d FROM h WHERE l >= 0) SELECT ray, arg_min(entity, (round(d, 9), entity)) AS entity, round(min(d), 9) AS distance FROM k WHERE d BETWEEN 0 AND 2 GROUP BY ray")
def _(spark, sf):
    p = positions(spark, sf)
    rays = p.where("label = 4").select(F.col("entity").alias("ray"), F.lit(-1.0).alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return spatial.raycast_all(p, rays, 0.05, 2.0).select("ray", "entity", F.round("distance", 9).alias("distance"))


@query("raycast_as_of", f"WITH {LOG}, {LAST.format(t=200)}, p AS (SELECT entity, max(CASE WHEN comp = 'click' THEN value END) AS x, max(CASE WHEN comp = 'view' THEN value END) AS y FROM last GROUP BY entity), h AS (SELECT entity, x - 0.0 AS l, (y-200)*(y-200) AS off FROM p WHERE x IS NOT NULL AND y IS NOT NULL) SELECT entity, round(l - sqrt(400 - off), 6) AS distance FROM h WHERE l >= 0 AND off <= 400 AND l - sqrt(400 - off) >= 0 ORDER BY l - sqrt(400 - off), entity LIMIT 1")
def _(spark, sf):
    p = wide(spark, sf, 200).select("entity", F.col("click").alias("x"), F.col("view").alias("y"), F.lit(0.0).alias("z")).dropna()
    return spatial.raycast(p, (0, 200, 0), (1, 0, 0), 20.0).select("entity", F.round("distance", 6).alias("distance"))


@query("ray_box", f"WITH {ITEMS}, t AS (SELECT entity, greatest(x, 0.0) AS a, x + 2 AS b, y - 30 AS y0, z - 5 AS z0 FROM items) SELECT entity, CASE WHEN y0 <= 0 AND y0 + 2 >= 0 AND z0 <= 0 AND z0 + 2 >= 0 AND a <= b THEN a ELSE -1.0 END AS distance FROM t")
def _(spark, sf):
    low = [F.col(n) for n in "xyz"]
    return items(spark, sf).select("entity", g.ray_box((0, 30, 5), (1, 0, 0), low, [c + 2 for c in low]).alias("distance"))


@query("boxes_meet", f"WITH {ITEMS} SELECT entity FROM items WHERE x <= 22 AND x + 1 >= 18 AND y <= 32 AND y + 1 >= 28 AND z <= 7 AND z + 1 >= 3")
def _(spark, sf):
    low = [F.col(n) for n in "xyz"]
    return items(spark, sf).where(g.boxes_meet(low, [c + 1 for c in low], [18, 28, 3], [22, 32, 7])).select("entity")


@query("fixed_point_functions", "WITH f AS (SELECT p_partkey, CAST(trunc(p_retailprice * 65536) AS BIGINT) AS a FROM part) SELECT p_partkey, CAST(floor(sqrt(CAST(a << 16 AS DOUBLE))) AS BIGINT) AS root, abs(-a) AS size, a + 65536 AS more, a - 65536 AS less FROM f")
def _(spark, sf):
    a = num.fix(F.col("p_retailprice"))
    one = F.lit(num.ONE)
    return table(spark, sf, "part").select("p_partkey", num.fix_sqrt(a).alias("root"), num.fix_abs(-a).alias("size"), num.fix_add(a, one).alias("more"), num.fix_sub(a, one).alias("less"))


@query("tiles_in_radius", "WITH t AS (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS tx, CAST(n_regionkey AS BIGINT) AS ty FROM nation) SELECT DISTINCT tx + a AS tx, ty + b AS ty, CAST(c AS BIGINT) AS tz FROM t, (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b), (SELECT unnest(range(-1, 2)) AS c)")
def _(spark, sf):
    t = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("tx"), F.col("n_regionkey").cast("long").alias("ty"), F.lit(0).cast("long").alias("tz")).distinct()
    return nav.tiles_in_radius(t, 1)


@query("nav_linked", "WITH n AS (SELECT p_partkey AS node, p_size % 10 IN (2, 3) AS blocked FROM part), e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT DISTINCT ps.a, ps.b FROM (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity > 40) ps JOIN e ON ps.a = e.a AND ps.b = e.b WHERE ps.a IN (SELECT node FROM n WHERE NOT blocked) AND ps.b IN (SELECT node FROM n WHERE NOT blocked)")
def _(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 10).isin(2, 3).alias("blocked"))
    ties = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_quantity")
    return nav.linked(ties.where("l_quantity > 40").select("a", "b").distinct(), nodes, ties)


@query("access_decay", f"WITH {LOG} SELECT comp, round(sum(pow(0.5, 719 - tick)), 9) AS accesses FROM log WHERE tick <= 719 GROUP BY comp")
def _(spark, sf):
    return devtools.decayed(log(spark, sf), 719).select("comp", F.round("accesses", 9).alias("accesses"))


@query("health_profile", f"WITH {LOG}, {LAST.format(t=5)}, {WIDE}, a AS (SELECT {SIG} AS s, count(*) AS n FROM w GROUP BY 1), o AS (SELECT count(*) AS n, count(*) FILTER (n BETWEEN 1 AND 7) AS sparse, avg(CASE WHEN n % 256 = 0 THEN 1.0 ELSE (floor(n / 256) + (n % 256) / 256.0) / (floor(n / 256) + 1) END) AS occupancy FROM a) SELECT n, sparse, round(occupancy, 9) AS occupancy, round((8 + 63) / 64.0, 9) AS lines, round((1 - sparse / n) * 60 + 40 / ((8 + 63) / 64.0), 9) AS health FROM o")
def _(spark, sf):
    strides = spark.createDataFrame([(c, 8) for c in COMPS], "comp string, stride int")
    out = devtools.profile(devtools.archetypes(wide(spark, sf, 5)), strides)
    return out.select("n", "sparse", F.round("occupancy", 9).alias("occupancy"), F.round("lines", 9).alias("lines"), F.round("health", 9).alias("health"))


@query("subscription_following", f"WITH {POS}, {SUBS} SELECT sub, round(cx + x, 9) AS cx, round(cy + y, 9) AS cy, round(cz + z, 9) AS cz FROM subs JOIN pos ON pos.entity = subs.sub")
def _(spark, sf):
    p = positions(spark, sf)
    subs = subscriptions(p, 0.1).withColumn("owner", F.col("sub").cast("long"))
    moved = interest.following(subs, p)
    return moved.select("sub", *(F.round("c" + n, 9).alias("c" + n) for n in "xyz"))


@query("wide_update_sandbox", "SELECT c_custkey AS entity, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_acctbal IS NOT NULL")
def _(spark, sf):
    box = schema.Sandbox(table(spark, sf, "customer").withColumnRenamed("c_custkey", "entity"), writes=frozenset({"c_acctbal"}))
    return box.update(F.col("c_acctbal") < 0, c_acctbal=F.lit(0.0)).query("c_acctbal")


@query("gql_create_insert_offset", "SELECT * FROM (VALUES (2, 'b'), (3, 'c')) t(k, name)")
def _(spark, sf):
    e = Engine(spark)
    for text in ("CREATE TABLE t (k INT, name TEXT)", "INSERT INTO t (k, name) VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd')"):
        e.query(text)
    return e.query("SELECT k, name FROM t ORDER BY k LIMIT 2 OFFSET 1")


@query("blackboard_numbers", "SELECT user_id AS agent, event_id AS seq, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN CAST(event_id AS DOUBLE) WHEN 'error' THEN CAST(value > 250 AS INT)::DOUBLE END AS number FROM events")
def _(spark, sf):
    from ..operators.agents import as_number

    kind = F.when(F.col("event_type") == "click", "float").when(F.col("event_type") == "view", "int").when(F.col("event_type") == "error", "bool")
    return table(spark, sf, "events").select(F.col("user_id").alias("agent"), F.col("event_id").alias("seq"), as_number(kind, F.col("value"), F.col("event_id"), F.col("value") > 250).alias("number"))


@query("float_codec_round_trip", "SELECT vec_id, count(*) AS n, max(abs(v - round(v / (m / 32767)) * (m / 32767))) <= max(m) / 32767 AS close FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, list_max([abs(CAST(x AS DOUBLE)) FOR x IN embedding]) AS m FROM embeddings) GROUP BY vec_id")
def _(spark, sf):
    t = table(spark, sf, "embeddings")
    back = delta.restore_floats(delta.quantize_floats(F.col("embedding")))
    most = F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    error = F.array_max(F.zip_with("embedding", back, lambda a, b: F.abs(a.cast("double") - b)))
    return t.select("vec_id", F.size("embedding").cast("long").alias("n"), (error <= most / 32767).alias("close"))
