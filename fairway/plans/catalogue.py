"""The query catalogue over the star-schema tables, each with its DuckDB equivalent."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway import schemas
from fairway.functions import scalars as X
from fairway.operators import changes, codes, governance, match, ordered, parsing, relational as R, routes, search, stats
from fairway.plans import stages
from fairway.sources import adapters as A
from fairway.sources.tables import table

DAY = datetime.date(1998, 6, 15)
DATES = {"stat_date", "day"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, plain: str = ""):
    """Registers a query under `name`, with its SQL where there is one.

    plain: columns that leave as JSON would have them: dates as ISO text, decimals as numbers.
    """
    columns = plain.split()

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string" if c in DATES else "double") for c in columns})

        QUERIES[name] = run
        if sql:
            kinds = ", ".join(f"CAST({c} AS {'VARCHAR' if c in DATES else 'DOUBLE'}) AS {c}" for c in columns)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({kinds}) FROM ({sql})" if columns else sql
        return f

    return put


@query(
    "q01_heatmap_daily",
    """SELECT CAST(l_shipdate AS DATE) AS stat_date, l_suppkey AS node_id, 'CARGO_ORIGIN' AS stat_type,
              count(*) AS cargo_count, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(16,2)) AS total_tonnage
       FROM lineitem GROUP BY 1, 2""", plain="stat_date total_tonnage")
def heatmap_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cargo count and tonnage by origin node and loading day."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("stat_date"), F.col("l_suppkey").alias("node_id"))
        .agg(F.count("*").alias("cargo_count"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("decimal(16,2)").alias("total_tonnage"))
        .withColumn("stat_type", F.lit("CARGO_ORIGIN"))
    )


@query("q02_equal_filters", """SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'""")
def equal_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional equalities; those that are None drop out."""
    o = A.orders(spark, sf_dir)
    return o.where(R.equal_filters(status="F", input_type="2-HIGH", customer_id=None)).select("id", "customer_id", "status")


@query("q03_falsy_filters", """SELECT s_suppkey AS id, s_name AS name FROM supplier""")
def falsy_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter value of 0 is no filter in this mode, though key 0 exists."""
    return A.nodes(spark, sf_dir).where(R.equal_filters("falsy", id=0)).select("id", "name")


@query("q03b_key_zero", """SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey = 0""")
def key_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same value filters in the other mode."""
    return A.nodes(spark, sf_dir).where(R.equal_filters("none", id=0)).select("id", "name")


@query("q04_keyword_or", """SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%RED%'""")
def keyword_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return p.where(R.keyword(["name", "brand"], "RED"))


@query("q05_keyword_wildcard", """SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name ILIKE '%r_d%g%'""")
def keyword_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcards in the keyword stay live."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return p.where(R.keyword(["name"], "r_d%g"))


@query("q06_date_range", """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'""", plain="day")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the bounds are on the stored column, so that they reach the scan; midnight closes the last day
    o = A.orders(spark, sf_dir)
    end = datetime.datetime(1998, 1, 31, 23, 59, 59, 999999)
    return o.where(F.col("created_at").between(F.lit(datetime.datetime(1998, 1, 1)).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).select("id", F.to_date("created_at").alias("day"))


@query("q07_parent", """WITH t AS (SELECT r_regionkey AS code, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation)
SELECT 'top' AS branch, CAST(code AS BIGINT) AS code, name FROM t WHERE parent IS NULL UNION ALL SELECT 'child', code, name FROM t WHERE parent = 2""")
def parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null parent is the top level; another value selects its children."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("code"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("code"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    t = r.unionByName(n)
    top = t.where(R.parent_is("parent", None)).select(F.lit("top").alias("branch"), "code", "name")
    return top.unionByName(t.where(R.parent_is("parent", 2)).select(F.lit("child").alias("branch"), "code", "name"))


@query("q07b_unknown_parent", """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_regionkey AS region FROM nation""")
def unknown_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown parent code drops the filter."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    parents = table(spark, sf_dir, "region").select(F.col("r_name").alias("code"))
    return R.under_parent_code(n, parents, "NOWHERE", "region")


@query("q08_page_newest", """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20""", plain="day")
def page_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(A.orders(spark, sf_dir), [F.desc("created_at"), F.desc("id")], 2, 20).select("id", F.to_date("created_at").alias("day"))


@query("q09_page_total", """SELECT o_orderkey AS id, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.orders(spark, sf_dir).where(R.equal_filters(status="O"))
    return R.page_with_total(o, [F.desc("created_at"), F.desc("id")], 1, 10).select("id", "total")


@query("q10_page_sort_order", """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_regionkey AS sort_order FROM nation ORDER BY n_regionkey, n_nationkey LIMIT 10 OFFSET 5""")
def page_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("sort_order"))
    return n.orderBy("sort_order", "id").offset(5).limit(10)


@query("q11_status_counts", """SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.orders(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("q12_conditional_counts", """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open_count, count(*) FILTER (o_orderstatus = 'F') AS final_count FROM orders""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = lambda s: F.count(F.when(F.col("status") == s, 1))
    return A.orders(spark, sf_dir).agg(F.count("*").alias("total"), hit("O").alias("open_count"), hit("F").alias("final_count"))


_AUDIT = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'NODE' WHEN 1 THEN 'VESSEL' WHEN 2 THEN 'VESSEL_TYPE' WHEN 3 THEN 'COMMODITY' ELSE 'ROUTE' END AS target_type,
 user_id AS submitter_id, CASE WHEN event_type IN ('view', 'click') THEN 'PENDING' WHEN event_type = 'error' THEN 'REJECTED' ELSE 'APPROVED' END AS audit_result, ts AS created_at FROM events"""


@query("q13_pending_by_type", f"""WITH a AS ({_AUDIT}), k AS (SELECT unnest(['NODE','VESSEL','VESSEL_TYPE','COMMODITY','ROUTE','REGION']) AS kind),
c AS (SELECT kind, count(id) AS n FROM k LEFT JOIN a ON kind = target_type AND audit_result = 'PENDING' GROUP BY kind)
SELECT kind, n FROM c UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT) FROM c""")
def pending_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending records of a fixed list of types, zeros included, and their total."""
    a = A.audit_records(spark, sf_dir).where("audit_result = 'PENDING'")
    return R.counts_with_zeros(a, "target_type", ["NODE", "VESSEL", "VESSEL_TYPE", "COMMODITY", "ROUTE", "REGION"])


@query("q14_newest_of_key", """SELECT event_id AS id, user_id AS vessel_id, event_type AS vessel_status FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 50""")
def newest_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.newest(A.vessel_events(spark, sf_dir), "vessel_id", 8, [F.desc("ts"), F.desc("id")], 50).select("id", "vessel_id", "vessel_status")


@query("q15_stale_sweep", """SELECT event_id AS id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR THEN 'PENDING' ELSE event_type END AS status FROM events""")
def stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.vessel_events(spark, sf_dir).select("id", F.col("vessel_status").alias("status"), F.col("ts").alias("updated_at"))
    return governance.stale_reset(e, datetime.datetime(2024, 1, 20), 1, busy="view").select("id", "status")


@query("q16_clean_text", """SELECT doc_id AS id, replace(replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '，', ','), '。', '.') AS cleaned FROM documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.clean_text(F.col("text")).alias("cleaned"))


@query("q17_extract_phone", """SELECT doc_id AS id, nullif(regexp_extract(text, '1[3-9][0-9]{9}', 0), '') AS phone FROM documents""")
def extract_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.extract_phone(F.col("text")).alias("phone"))


@query("q18_tonnage", """WITH t AS (SELECT p_partkey AS id, CAST(p_size AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN '万吨' WHEN 1 THEN '千吨' WHEN 2 THEN '吨' ELSE '.5万吨' END AS x FROM part)
SELECT id, CAST(nullif(regexp_extract(replace(replace(x, '万吨', '0000'), '千吨', '000'), '([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS compat,
 CAST(CAST(regexp_extract(x, '([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) * CASE WHEN x LIKE '%万吨' THEN 10000 WHEN x LIKE '%千吨' THEN 1000 ELSE 1 END AS DOUBLE) AS fixed FROM t""")
def tonnage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of tonnage texts."""
    i = F.pmod("p_partkey", F.lit(4))
    unit = F.when(i == 0, "万吨").when(i == 1, "千吨").when(i == 2, "吨").otherwise(".5万吨")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_size").cast("string"), unit).alias("x"))
    return p.select("id", X.normalize_tonnage(F.col("x")).alias("compat"), X.normalize_tonnage(F.col("x"), "fixed").alias("fixed"))


@query("q19_safe_date", """SELECT o_orderkey AS id, CAST(try_strptime(CASE WHEN o_orderkey % 5 = 0 THEN '1998-13-' || CAST(o_orderkey % 9 AS VARCHAR) ELSE strftime(o_orderdate, '%Y-%m-%d') END, '%Y-%m-%d') AS DATE) AS day FROM orders""", plain="day")
def safe_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are no dates give null."""
    text = F.when(F.pmod("id", F.lit(5)) == 0, F.concat(F.lit("1998-13-"), F.pmod("id", F.lit(9)).cast("string"))).otherwise(F.date_format("created_at", "yyyy-MM-dd"))
    return A.orders(spark, sf_dir).select("id", X.safe_date(text).alias("day"))


_NODES = """SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS waterway_id, CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END AS status,
 CAST((s_suppkey * 37) % 200 AS DOUBLE) / 10.0::DOUBLE + 100.0::DOUBLE AS longitude, CAST((s_suppkey * 53) % 150 AS DOUBLE) / 10.0::DOUBLE + 22.0::DOUBLE AS latitude FROM supplier"""
_ALIASES = """SELECT s_suppkey * 2 AS id, s_suppkey AS node_id, 'S' || CAST(s_suppkey AS VARCHAR) AS alias_name, CAST(s_suppkey % 10 AS INTEGER) AS priority, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 END AS status FROM supplier
 UNION ALL SELECT s_suppkey * 2 + 1, s_suppkey, n_name || '-' || CAST(s_suppkey AS VARCHAR), 5, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


@query("q20_distances", f"""WITH n AS ({_NODES}), p AS (SELECT a.id AS origin_id, b.id AS dest_id, radians(a.latitude) AS p1, radians(b.latitude) AS p2, radians(b.latitude - a.latitude) AS dp, radians(b.longitude - a.longitude) AS dl FROM n a JOIN n b ON b.id = a.id + 1),
h AS (SELECT origin_id, dest_id, power(sin(dp / 2), 2) + cos(p1) * cos(p2) * power(sin(dl / 2), 2) AS a FROM p)
SELECT origin_id, dest_id, CAST(6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)) AS DECIMAL(12, 2)) AS km, CAST(6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)) * 1.5::DOUBLE AS DECIMAL(12, 2)) AS waterway_km FROM h""", plain="km waterway_km")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight and river distances between nodes of consecutive ids."""
    n = A.nodes(spark, sf_dir)
    b = n.select((F.col("id") - 1).alias("id"), F.col("id").alias("dest_id"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    km = X.haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2"))
    return n.join(b, "id").select(F.col("id").alias("origin_id"), "dest_id", km.cast("decimal(12,2)").alias("km"), X.waterway_km(km).cast("decimal(12,2)").alias("waterway_km"))


@query("q21_codes", """SELECT CAST(100 + n_nationkey AS BIGINT) AS id, printf('%02d-%s-%03d', n_regionkey + 1, CASE WHEN n_nationkey % 5 = 0 THEN '03' ELSE '02' END, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) AS code FROM nation""")
def waterway_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes for a batch of children, numbered on after each parent's existing ones."""
    r = table(spark, sf_dir, "region")
    old = r.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.format_string("%02d-01-001", F.col("r_regionkey") + 1).alias("code"))
    old = old.unionByName(r.select((F.col("r_regionkey") + 50).cast("long").alias("id"), F.col("r_regionkey").cast("long").alias("parent_id"), F.format_string("%02d-02-001", F.col("r_regionkey") + 1).alias("code")))
    new = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, 3).otherwise(2).alias("level"), F.col("n_regionkey").cast("long").alias("parent_id"))
    return codes.allocate(new, old, ["id"]).select("id", "code")


@query("q22_json", """SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON that may be wrapped in other text."""
    e = A.vessel_events(spark, sf_dir)
    return e.select("id", X.json_rescue(F.concat(F.lit("reply: "), "props", F.lit(" end")), "k int")["k"].alias("k"))


@query("q23_active_aliases", f"""SELECT a.id AS alias_id, a.alias_name, n.id AS node_id, n.name FROM ({_ALIASES}) a JOIN ({_NODES}) n ON a.node_id = n.id WHERE a.status = 1 AND n.status = 1""")
def active_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, n = A.node_aliases(spark, sf_dir).where("status = 1"), A.nodes(spark, sf_dir).where("status = 1")
    return a.select(F.col("id").alias("alias_id"), "alias_name", "node_id").join(n.select(F.col("id").alias("node_id"), "name"), "node_id").select("alias_id", "alias_name", "node_id", "name")


@query("q24_name_or_alias", f"""SELECT id, name FROM ({_NODES}) n WHERE name ILIKE '%00007%' OR id IN (SELECT node_id FROM ({_ALIASES}) a WHERE alias_name ILIKE '%00007%')""")
def name_or_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_name_or_alias(A.nodes(spark, sf_dir), A.node_aliases(spark, sf_dir), "00007").select("id", "name")


@query("q24b_alias_only", f"""SELECT id, name FROM ({_NODES}) n WHERE name ILIKE '%nation_1-%' OR id IN (SELECT node_id FROM ({_ALIASES}) a WHERE alias_name ILIKE '%nation_1-%')""")
def alias_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_name_or_alias(A.nodes(spark, sf_dir), A.node_aliases(spark, sf_dir), "nation_1-").select("id", "name")


@query("q25_conflicts", """SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'conflict' ELSE 'accepted' END AS outcome FROM customer""")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that exist already, and those that are new."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    o = A.orders(spark, sf_dir).where("status = 'F'").select(F.col("customer_id").alias("id"))
    return changes.present(c, o, ["id"]).withColumn("outcome", F.lit("conflict")).unionByName(changes.absent(c, o, ["id"]).withColumn("outcome", F.lit("accepted")))


@query("q26_children", """SELECT r_regionkey AS id, coalesce((SELECT string_agg(n_name, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey <> 3), '') AS children FROM region""")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with their children in order."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))
    n = table(spark, sf_dir, "nation").where("n_nationkey <> 3")
    out = R.nested(r, n, "id", "n_regionkey", ["n_nationkey", "n_name"])
    return out.select("id", F.array_join(F.transform("children", lambda x: x["n_name"]), ",").alias("children"))


@query("q26b_order_lines", """SELECT o_orderkey AS id, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.orders(spark, sf_dir).select("id")
    out = R.nested(o, table(spark, sf_dir, "lineitem"), "id", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("id", F.array_join(F.transform("children", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("q27_roles", """WITH r AS (SELECT unnest([0, 1, 2, 3]) AS id, unnest(['SUPER_ADMIN', 'ADMIN', 'OPERATOR', 'VIEWER']) AS code), l AS (SELECT c_custkey AS user_id, c_custkey % 4 AS role_id FROM customer WHERE c_custkey % 6 <> 0 UNION SELECT c_custkey, c_nationkey % 4 FROM customer WHERE c_custkey % 6 <> 0)
SELECT c_custkey AS id, coalesce(string_agg(code, ',' ORDER BY code), '') AS roles, coalesce(bool_or(code IN ('SUPER_ADMIN', 'ADMIN')), false) AS may_audit FROM customer LEFT JOIN l ON user_id = c_custkey LEFT JOIN r ON r.id = role_id GROUP BY 1""")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their role codes, and whether they may audit."""
    c = table(spark, sf_dir, "customer")
    role = spark.createDataFrame([(0, "SUPER_ADMIN"), (1, "ADMIN"), (2, "OPERATOR"), (3, "VIEWER")], "id int, code string")
    linked = c.where(F.pmod("c_custkey", F.lit(6)) != 0)
    links = linked.select(F.col("c_custkey").alias("user_id"), F.pmod("c_custkey", F.lit(4)).cast("int").alias("role_id")).unionByName(linked.select(F.col("c_custkey").alias("user_id"), F.pmod("c_nationkey", F.lit(4)).alias("role_id")))
    out = governance.role_codes(c.select(F.col("c_custkey").alias("id")), links, role)
    return out.select("id", F.array_join("roles", ",").alias("roles"), governance.may(F.col("roles"), "ADMIN").alias("may_audit"))


@query("q28_star", """SELECT CAST(l_shipdate AS DATE) AS stat_date, s_name AS node_name, n_name AS nation, r_name AS region, count(*) AS cargo_count, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(16,2)) AS total_tonnage
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-07-01' GROUP BY 1, 2, 3, 4""", plain="stat_date total_tonnage")
def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heatmap with names: aggregated on keys first, then joined to the dimensions."""
    span = F.col("l_shipdate").between(F.lit(datetime.datetime(1998, 1, 1)).cast("timestamp_ntz"), F.lit(datetime.datetime(1998, 6, 30, 23, 59, 59, 999999)).cast("timestamp_ntz"))
    li = table(spark, sf_dir, "lineitem").where(span)
    cargo = li.select(F.col("l_suppkey").alias("origin_node_id"), F.to_date("l_shipdate").alias("loading_date"), F.col("l_quantity").cast("decimal(12,2)").alias("tonnage"))
    heat = stats.cargo_heatmap(cargo, "origin_node_id", "CARGO_ORIGIN")
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    places = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("node_name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return heat.join(places, "node_id").select("stat_date", "node_name", "nation", "region", "cargo_count", "total_tonnage")


@query("q29_parent_join", """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name AS parent_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def parent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent_name"))


def _origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cargo_heatmap(A.opportunities(spark, sf_dir), "origin_node_id", "CARGO_ORIGIN")


@query("q30_dashboard", """SELECT (SELECT count(*) FROM orders) AS total_opportunities, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS active_opportunities, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_opportunities,
 (SELECT count(DISTINCT user_id) FROM events) AS active_vessels, (SELECT count(*) FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-06-08' AND DATE '1998-06-15') AS recent_cargo""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dashboard(A.orders(spark, sf_dir), A.vessel_events(spark, sf_dir), _origin(spark, sf_dir), DAY, 7, "O", "P")


@query("q31_heatmap_region", f"""WITH n AS ({_NODES}) SELECT CAST(l_shipdate AS DATE) AS stat_date, l_suppkey AS node_id, n.name AS node_name, n.longitude, n.latitude, count(*) AS cargo_count FROM lineitem JOIN n ON l_suppkey = n.id JOIN nation ON waterway_id = n_nationkey
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-06-01' AND DATE '1998-06-15' AND n_regionkey = 2 GROUP BY ALL""", plain="stat_date")
def heatmap_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of dates and a region, both honoured."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("waterway_id"), F.col("n_regionkey").alias("region_id"))
    places = A.nodes(spark, sf_dir).join(n, "waterway_id")
    out = stats.heatmap_on(_origin(spark, sf_dir), places, datetime.date(1998, 6, 1), DAY, "CARGO_ORIGIN", 2)
    return out.select("stat_date", "node_id", "node_name", "longitude", "latitude", "cargo_count")


_VESSEL = """SELECT CAST(ts AS DATE) AS stat_date, user_id % 10 AS node_id, count(DISTINCT user_id) AS vessel_count FROM events GROUP BY 1, 2"""


@query("q32_vessel_heatmap", f"""SELECT stat_date, node_id, vessel_count, CAST(total AS DECIMAL(16,2)) AS total_deadweight FROM ({_VESSEL}) JOIN (SELECT stat_date, node_id, sum(d) AS total FROM (SELECT CAST(ts AS DATE) AS stat_date, user_id % 10 AS node_id, user_id, max(CAST(1000 + user_id % 50 AS DECIMAL(12,2))) AS d FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (stat_date, node_id)""", plain="stat_date total_deadweight")
def vessel_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.vessel_heatmap(_vessel_days(spark, sf_dir)).drop("stat_type")


def _vessel_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.vessel_events(spark, sf_dir)
    return e.select(F.to_date("ts").alias("stat_date"), F.pmod("vessel_id", F.lit(10)).alias("node_id"), "vessel_id", (F.pmod("vessel_id", F.lit(50)) + 1000).cast("decimal(12,2)").alias("deadweight"))


@query("q33_trend", """SELECT CAST(l_shipdate AS DATE) AS stat_date, count(*) AS value FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-05-16' AND DATE '1998-06-15' GROUP BY 1""", plain="stat_date")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 days back gives 31 dates."""
    return stats.trend(_origin(spark, sf_dir), DAY, 30)


@query("q34_top_nodes", """SELECT l_suppkey AS node_id, count(*) AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_nodes(_origin(spark, sf_dir), 10)


_DEST = """SELECT CAST(l_shipdate AS DATE) AS stat_date, CAST(c_nationkey AS BIGINT) AS node_id, count(*) AS cargo_count, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(16,2)) AS total_tonnage FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


@query("q35_heatmap_types", f"""SELECT stat_date, node_id, 'CARGO_ORIGIN' AS stat_type, cargo_count, total_tonnage, CAST(0 AS BIGINT) AS vessel_count, CAST(0 AS DECIMAL(16,2)) AS total_deadweight FROM (SELECT CAST(l_shipdate AS DATE) AS stat_date, l_suppkey AS node_id, count(*) AS cargo_count, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(16,2)) AS total_tonnage FROM lineitem GROUP BY 1, 2)
UNION ALL SELECT stat_date, node_id, 'CARGO_DEST', cargo_count, total_tonnage, 0, 0 FROM ({_DEST})
UNION ALL SELECT stat_date, node_id, 'VESSEL', 0, 0, vessel_count, CAST(total AS DECIMAL(16,2)) FROM ({_VESSEL}) JOIN (SELECT stat_date, node_id, sum(d) AS total FROM (SELECT CAST(ts AS DATE) AS stat_date, user_id % 10 AS node_id, user_id, max(CAST(1000 + user_id % 50 AS DECIMAL(12,2))) AS d FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (stat_date, node_id)""", plain="stat_date total_tonnage total_deadweight")
def heatmap_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins, destinations and vessels in one table of statistics."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    to = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("order_id"), F.col("c_nationkey").cast("long").alias("dest_node_id"))
    dest = A.opportunities(spark, sf_dir).join(to, "order_id")
    return stats.all_types(_origin(spark, sf_dir), stats.cargo_heatmap(dest, "dest_node_id", "CARGO_DEST"), stats.vessel_heatmap(_vessel_days(spark, sf_dir)))


@query("q36_merge", """WITH h AS (SELECT CAST(l_shipdate AS DATE) AS stat_date, l_suppkey AS node_id, l_returnflag AS f FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_shipdate < TIMESTAMP '1998-06-16'),
o AS (SELECT stat_date, node_id, count(*) AS n FROM h WHERE f <> 'N' GROUP BY 1, 2), w AS (SELECT stat_date, node_id, count(*) AS n FROM h WHERE f <> 'A' GROUP BY 1, 2)
SELECT coalesce(w.stat_date, o.stat_date) AS stat_date, coalesce(w.node_id, o.node_id) AS node_id, coalesce(w.n, o.n) AS cargo_count FROM o FULL OUTER JOIN w ON o.stat_date = w.stat_date AND o.node_id = w.node_id""", plain="stat_date")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New statistics over stored ones; nodes without new cargo keep their row."""
    cargo = A.opportunities(spark, sf_dir).where(F.col("loading_date").between(F.lit(datetime.date(1998, 6, 1)), F.lit(DAY)))
    old = stats.cargo_heatmap(cargo.where("status <> 'N'"), "origin_node_id", "CARGO_ORIGIN")
    new = stats.cargo_heatmap(cargo.where("status <> 'A'"), "origin_node_id", "CARGO_ORIGIN")
    return stats.merge(old, new).select("stat_date", "node_id", "cargo_count")


@query("q37_report", """WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS node FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-05-16' AND DATE '1998-06-15'),
t AS (SELECT node, count(*) AS v FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5), s AS (SELECT day, count(*) AS v FROM d GROUP BY 1 ORDER BY 1 DESC LIMIT 5)
SELECT CAST(row_number() OVER (ORDER BY v DESC, node) AS INTEGER) AS line_no, 'node ' || node || ': ' || v AS line FROM t UNION ALL SELECT CAST(5 + row_number() OVER (ORDER BY day) AS INTEGER), day || ': ' || v FROM s""")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.report_lines(_origin(spark, sf_dir), DAY, 30)


def _goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names as goods with two aliases."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return names.select("id", "name", F.array(F.regexp_replace("name", " ", "-"), F.element_at(F.split("name", " "), 2)).alias("aliases"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to link: part names as they are, shortened, extended, misspelt and shouted."""
    i = F.pmod("p_partkey", F.lit(7))
    n = F.col("p_name")
    text = F.when(i == 0, n).when(i == 1, F.upper(n)).when(i == 2, F.concat(F.lit(" fresh "), n)).when(i == 3, F.substring(n, 1, 5)).when(i == 4, F.regexp_replace(n, " ", "-")).when(i == 5, F.regexp_replace(n, "e", "a")).otherwise(F.reverse(n))
    return table(spark, sf_dir, "part").select(text.alias("text"))


_GOODS = """SELECT min(p_partkey) AS id, p_name AS name, [replace(p_name, ' ', '-'), split_part(p_name, ' ', 2)] AS aliases FROM part GROUP BY p_name"""
_ASKED = """SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN ' fresh ' || p_name WHEN 3 THEN substring(p_name, 1, 5) WHEN 4 THEN replace(p_name, ' ', '-') WHEN 5 THEN replace(p_name, 'e', 'a') ELSE reverse(p_name) END AS text FROM part"""


def _ratios(pairs: str) -> str:
    """Common table expressions that end in ratio (a, b, r): the similarity of the distinct pairs (a, b) that can reach 0.5.

    r is twice the characters in matching blocks over those of both texts. The longest block of two stretches, ties by
    its place in a, then in b, cuts them into what is left and right of it, and so on. For texts of b below 200 characters.
    """
    return f"""pr AS MATERIALIZED (SELECT row_number() OVER () AS p, a, b FROM (SELECT DISTINCT a, b FROM ({pairs})) WHERE least(length(a), length(b)) > 0 AND 4 * least(length(a), length(b)) >= length(a) + length(b)),
eq AS (SELECT p, i, j FROM (SELECT p, unnest(range(1, length(a) + 1)) AS i, unnest(string_split(a, '')) AS c FROM pr) JOIN (SELECT p, unnest(range(1, length(b) + 1)) AS j, unnest(string_split(b, '')) AS c FROM pr) USING (p, c)),
runs AS MATERIALIZED (SELECT p, i, j, max(i) OVER (PARTITION BY p, i - j, g) - i + 1 AS run FROM (SELECT *, i - row_number() OVER (PARTITION BY p, i - j ORDER BY i) AS g FROM eq)),
seg(p, a0, a1, b0, b1, m) AS (SELECT p, CAST(1 AS BIGINT), length(a) + 1, CAST(1 AS BIGINT), length(b) + 1, CAST(0 AS BIGINT) FROM pr UNION ALL
SELECT p, CASE side WHEN 0 THEN a0 ELSE x[2] - x[1] END, CASE side WHEN 0 THEN x[2] ELSE a1 END, CASE side WHEN 0 THEN b0 ELSE x[3] - x[1] END, CASE side WHEN 0 THEN x[3] ELSE b1 END, CASE side WHEN 0 THEN -x[1] ELSE 0 END
FROM (SELECT p, a0, a1, b0, b1, min([-least(run, a1 - i, b1 - j), i, j]) AS x FROM seg JOIN runs USING (p) WHERE i >= a0 AND i < a1 AND j >= b0 AND j < b1 GROUP BY ALL), (SELECT unnest([0, 1]) AS side)),
ratio AS MATERIALIZED (SELECT a, b, 2.0::DOUBLE * CAST(sum(m) AS DOUBLE) / (length(a) + length(b)) AS r FROM seg JOIN pr USING (p) GROUP BY p, a, b)"""


def _entity_matches(asked: str, entities: str, top: int = 3) -> str:
    """SQL of the first matcher: (text, id, name, score, via, rank) of the texts of `asked` in the dictionary (id, name, aliases)."""
    return f"""WITH RECURSIVE q AS (SELECT DISTINCT text, lower(trim(text)) AS t FROM ({asked}) WHERE text <> ''), d AS (SELECT id, name, lower(name) AS n, [lower(x) FOR x IN aliases] AS al FROM ({entities})),
forms AS (SELECT id, n AS form, 1 AS is_name FROM d UNION ALL SELECT id, unnest(al), 0 FROM d), {_ratios("SELECT t AS a, form AS b FROM q, forms")},
near AS (SELECT t, id, max([CAST(trunc(r * 100) AS INTEGER), is_name]) AS best FROM ratio JOIN forms ON b = form JOIN q ON a = t GROUP BY ALL),
ruled AS (SELECT text, t, id, name, CASE WHEN t = n THEN 100 WHEN list_contains(al, t) THEN 95 WHEN contains(t, n) OR contains(n, t) THEN 85 WHEN len([x FOR x IN al IF contains(t, x) OR contains(x, t)]) > 0 THEN 80 END AS s FROM q, d),
scored AS (SELECT text, id, name, coalesce(s, best[1]) AS score, CASE s WHEN 100 THEN 'exact' WHEN 95 THEN 'alias_exact' WHEN 85 THEN 'contains' WHEN 80 THEN 'alias_contains' ELSE CASE best[2] WHEN 1 THEN 'fuzzy' ELSE 'alias_fuzzy' END END AS via FROM ruled LEFT JOIN near USING (t, id))
SELECT text, id, name, CAST(score AS INTEGER) AS score, via, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored WHERE score >= 60 QUALIFY rank <= {top}"""


def _name_matches(asked: str, rows: str, top: int = 5) -> str:
    """SQL of the second matcher: (text, id, name, matched, score, priority, rank) of the texts of `asked` in the rows (id, name, matched, priority, kind, ord)."""
    return f"""WITH RECURSIVE q AS (SELECT DISTINCT text, lower(trim(text)) AS t FROM ({asked}) WHERE text <> ''), f AS (SELECT *, lower(trim(matched)) AS m FROM ({rows}) WHERE matched <> ''), {_ratios("SELECT t AS a, m AS b FROM q, f")},
scored AS (SELECT text, id, name, matched, priority, kind, ord, CASE WHEN t = m THEN 1.0::DOUBLE WHEN contains(t, m) OR contains(m, t) THEN 0.85::DOUBLE ELSE r END AS s FROM q CROSS JOIN f LEFT JOIN ratio ON a = t AND b = m),
best AS (SELECT *, round_even(s * 100, 0) AS score, row_number() OVER (PARTITION BY text, id ORDER BY round_even(s * 100, 0) DESC, kind, ord) AS n, first_value(kind) OVER w AS k0, first_value(ord) OVER w AS o0 FROM scored WHERE s >= 0.5 WINDOW w AS (PARTITION BY text, id ORDER BY kind, ord))
SELECT text, id, name, matched, CAST(score AS INTEGER) AS score, priority, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, priority DESC NULLS LAST, k0, o0) AS INTEGER) AS rank FROM best WHERE n = 1 QUALIFY rank <= {top}"""


@query("q38_match_rules", f"""WITH p AS (SELECT text, lower(trim(text)) AS t, id, name, [lower(x) FOR x IN aliases] AS a FROM ({_ASKED}), ({_GOODS})),
s AS (SELECT text, id, name, CASE WHEN t = lower(name) THEN 100 WHEN list_contains(a, t) THEN 95 WHEN contains(t, lower(name)) OR contains(lower(name), t) THEN 85 WHEN len([x FOR x IN a IF contains(t, x) OR contains(x, t)]) > 0 THEN 80 END AS score FROM p)
SELECT text, id, name, CAST(score AS INTEGER) AS score, CASE score WHEN 100 THEN 'exact' WHEN 95 THEN 'alias_exact' WHEN 85 THEN 'contains' ELSE 'alias_contains' END AS via, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE score IS NOT NULL QUALIFY rank <= 3""")
def match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_entities(_asked(spark, sf_dir), _goods(spark, sf_dir), fuzzy=False)


@query("q39_match_entities", _entity_matches(_ASKED, _GOODS))
def match_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matcher with similarity."""
    return match.match_entities(_asked(spark, sf_dir), _goods(spark, sf_dir))


def _named_goods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Goods and their aliases as tables of the second matcher; one in eleven of either is inactive."""
    g = _goods(spark, sf_dir)
    active = lambda k: F.when(F.pmod(F.col("id") + k, F.lit(11)) == 0, 0).otherwise(1).alias("status")
    aliases = g.select("id", F.posexplode("aliases").alias("i", "alias_name")).select((F.col("id") * 2 + F.col("i")).alias("id"), F.col("id").alias("entity_id"), "alias_name", F.pmod("id", F.lit(10)).cast("int").alias("priority"), active(3))
    return g.select("id", "name", active(0)), aliases


_NAMED = f"""g AS ({_GOODS}), e AS (SELECT id, name FROM g WHERE id % 11 <> 0),
al AS (SELECT id * 2 + i AS id, id AS entity_id, aliases[i + 1] AS alias_name, CAST(id % 10 AS INTEGER) AS priority FROM g, (SELECT unnest([0, 1]) AS i) WHERE (id + 3) % 11 <> 0)"""
_NAMED_ROWS = f"""WITH {_NAMED} SELECT e.id, e.name, al.alias_name AS matched, al.priority, 0 AS kind, al.id AS ord FROM al JOIN e ON al.entity_id = e.id UNION ALL SELECT id, name, name, 5, 1, id FROM e"""


@query("q40_match_names", _name_matches(_ASKED, _NAMED_ROWS))
def match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second matcher, with similarity."""
    return match.match_names(_asked(spark, sf_dir), *_named_goods(spark, sf_dir), "entity_id")


@query("q40b_name_rules", f"""WITH {_NAMED}, f AS (SELECT e.id, e.name, al.alias_name AS matched, al.priority, 0 AS kind, al.id AS ord FROM al JOIN e ON al.entity_id = e.id UNION ALL SELECT id, name, name, 5, 1, id FROM e),
p AS (SELECT a.text, f.*, CASE WHEN matched = '' THEN 0 WHEN lower(trim(a.text)) = lower(trim(matched)) THEN 100 WHEN contains(lower(trim(a.text)), lower(trim(matched))) OR contains(lower(trim(matched)), lower(trim(a.text))) THEN 85 ELSE 0 END AS score FROM ({_ASKED}) a, f),
s AS (SELECT *, row_number() OVER (PARTITION BY text, id ORDER BY score DESC, kind, ord) AS n, first_value(kind) OVER w AS k0, first_value(ord) OVER w AS o0 FROM p WHERE score >= 50 WINDOW w AS (PARTITION BY text, id ORDER BY kind, ord))
SELECT text, id, name, matched, CAST(score AS INTEGER) AS score, priority, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, priority DESC, k0, o0) AS INTEGER) AS rank FROM s WHERE n = 1 QUALIFY rank <= 5""")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second matcher by its rules alone: aliases before names, the best row of each entity, ranks by score and priority."""
    return match.match_names(_asked(spark, sf_dir), *_named_goods(spark, sf_dir), "entity_id", fuzzy=False)


@query("q41_match_unpruned", _entity_matches(_ASKED, _GOODS))
def match_unpruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matcher without its length bound: the same result as q39."""
    return match.match_entities(_asked(spark, sf_dir), _goods(spark, sf_dir), prune=False)


@query("q42_confidence", """WITH s AS (SELECT doc_id AS id, CAST(doc_id % 101 AS INTEGER) AS a, CAST((doc_id * 7) % 101 AS INTEGER) AS b, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST((doc_id * 13) % 101 AS INTEGER) END AS c FROM documents)
SELECT id, CAST(trunc((a + b + coalesce(c, 0)) / 3) AS INTEGER) AS overall3, CAST(trunc((a + b + coalesce(c, 0) + 90) / 4) AS INTEGER) AS overall4, CASE WHEN c IS NULL THEN a ELSE CAST(trunc((a + c) / 2) AS INTEGER) END AS blended FROM s""")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of three and of four confidences, and the blend of two."""
    i = F.col("doc_id")
    score = lambda k: F.pmod(i * k, F.lit(101)).cast("int")
    s = table(spark, sf_dir, "documents").select(i.alias("id"), score(1).alias("a"), score(7).alias("b"), F.when(F.pmod(i, F.lit(3)) != 0, score(13)).alias("c"))
    return s.select("id", X.mean_truncated(F.col("a"), F.col("b"), F.col("c")).alias("overall3"), X.mean_truncated(F.col("a"), F.col("b"), F.col("c"), F.lit(90)).alias("overall4"), parsing.blended_confidence(F.col("a"), F.col("c"), F.col("c")).alias("blended"))


@query("q43_confirm", """WITH a AS (SELECT o_orderkey AS id, 1 AS n, CASE WHEN o_orderkey % 4 = 1 THEN 777 WHEN o_orderkey % 4 = 3 THEN 0 END AS origin, CASE WHEN o_orderkey % 4 = 2 THEN CAST(5 AS DECIMAL(12,3)) WHEN o_orderkey % 4 = 0 THEN CAST(0 AS DECIMAL(12,3)) END AS tons FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 2, 888, CAST(9 AS DECIMAL(12,3)) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 3, 999, CAST(7.5 AS DECIMAL(12,3)) FROM orders WHERE o_orderkey % 7 = 0)
SELECT o_orderkey AS parse_result_id, coalesce(nullif(origin, 0), o_custkey) AS origin_node_id, coalesce(nullif(tons, 0), CAST(o_totalprice AS DECIMAL(12,3))) AS tonnage, 'ACTIVE' AS status FROM orders JOIN a ON id = o_orderkey WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY n) = 1""", plain="tonnage")
def confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed results as opportunities: the first of up to three confirmations counts; overrides of 0 and null do not."""
    o = A.orders(spark, sf_dir)
    results = o.select("id", F.col("customer_id").alias("origin_node_id"), F.col("freight_price").cast("decimal(12,3)").alias("tonnage"), F.when(F.col("status") == "P", "PENDING_CONFIRM").otherwise("CONFIRMED").alias("parse_status"))
    i = F.pmod("id", F.lit(4))
    made = lambda n, where, origin, tons: o.where(where).select("id", origin.cast("long").alias("origin_node_id"), tons.cast("decimal(12,3)").alias("tonnage"), (F.lit(datetime.datetime(2024, 1, n)).cast("timestamp_ntz")).alias("confirmed_at"))
    third = F.pmod("id", F.lit(3)) == 0
    asked = made(3, F.pmod("id", F.lit(7)) == 0, F.lit(999), F.lit(7.5)).unionByName(made(2, third, F.lit(888), F.lit(9)))
    asked = asked.unionByName(made(1, third, F.when(i == 1, 777).when(i == 3, 0), F.when(i == 2, 5).when(i == 0, 0)))
    out, _ = parsing.confirm(results, asked, ["origin_node_id", "tonnage"])
    return out.select("parse_result_id", "origin_node_id", "tonnage", "status")


#: Up to three decisions on a record: each in turn by another kind of decider.
_DECIDED = """SELECT event_id AS id, n, CASE WHEN (event_id + n) % 11 = 0 THEN 'MAYBE' WHEN (event_id + n) % 3 = 0 THEN 'REJECT' ELSE 'APPROVE' END AS decision, CASE WHEN (event_id + n) % 4 = 0 THEN user_id ELSE user_id + 1 END AS auditor, CASE (event_id + n) % 7 WHEN 0 THEN 'SUPER_ADMIN' WHEN 1 THEN 'VIEWER' WHEN 2 THEN NULL ELSE 'ADMIN' END AS role
FROM events, (SELECT unnest([0, 1, 2]) AS n) WHERE event_id % 2 = 0 AND event_id % 5 >= n"""
_JUDGED = f"""SELECT a.id, n, a.audit_result, decision, auditor, CASE WHEN decision = 'MAYBE' THEN 'unknown decision' WHEN audit_result <> 'PENDING' THEN 'not pending' WHEN role IS NULL OR role = 'VIEWER' THEN 'no permission' WHEN auditor = submitter_id AND decision = 'APPROVE' AND role <> 'SUPER_ADMIN' THEN 'own submission' END AS refusal FROM ({_AUDIT}) a JOIN ({_DECIDED}) d ON a.id = d.id"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions of _DECIDED; some deciders have null roles, or a null among them."""
    e = table(spark, sf_dir, "events").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("event_id % 2 = 0 AND event_id % 5 >= n")
    i = F.col("event_id") + F.col("n")
    role = F.when(i % 7 == 0, "SUPER_ADMIN").when(i % 7 == 1, "VIEWER").when(i % 7 != 2, "ADMIN")
    decision = F.when(i % 11 == 0, "MAYBE").when(i % 3 == 0, "REJECT").otherwise("APPROVE")
    at = F.col("ts") + F.make_dt_interval(hours=F.col("n"))
    return e.select(F.col("event_id").alias("record_id"), decision.alias("decision"), F.when(i % 4 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("auditor_id"), F.when(i % 14 != 2, F.array(role)).alias("roles"), F.concat(F.lit("try "), F.col("n")).alias("remark"), at.alias("decided_at"))


@query("q44_audit", f"""WITH j AS ({_JUDGED}), w AS (SELECT id, arg_min(decision, n) AS decision, arg_min(auditor, n) AS auditor FROM j WHERE refusal IS NULL GROUP BY 1), f AS (SELECT id, arg_min(refusal, n) AS refusal FROM j GROUP BY 1)
SELECT a.id, CASE w.decision WHEN 'APPROVE' THEN 'APPROVED' WHEN 'REJECT' THEN 'REJECTED' ELSE a.audit_result END AS audit_result, w.auditor AS auditor_id, CASE WHEN w.id IS NULL THEN f.refusal END AS reject_reason FROM ({_AUDIT}) a LEFT JOIN w ON w.id = a.id LEFT JOIN f ON f.id = a.id""")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after up to three approvals and rejections each, under the rules of role and own submission."""
    return governance.decide(A.audit_records(spark, sf_dir), _decisions(spark, sf_dir)).select("id", "audit_result", "auditor_id", "reject_reason")


@query("q44b_refused", f"""WITH j AS ({_JUDGED}), w AS (SELECT id, min(n) AS won FROM j WHERE refusal IS NULL GROUP BY 1)
SELECT j.id AS record_id, 'try ' || n AS remark, CASE WHEN refusal = 'unknown decision' THEN refusal WHEN n > won THEN 'not pending' ELSE refusal END AS reject_reason FROM j LEFT JOIN w ON w.id = j.id WHERE refusal IS NOT NULL OR n > won""")
def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every refused decision with its reason."""
    return governance.refused(A.audit_records(spark, sf_dir), _decisions(spark, sf_dir)).select("record_id", "remark", "reject_reason")


@query("q45_latest", """SELECT user_id AS vessel_id, arg_max(event_id, (ts, event_id)) AS id, arg_max(event_type, (ts, event_id)) AS vessel_status FROM events GROUP BY 1""")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of each vessel."""
    return governance.latest(A.vessel_events(spark, sf_dir), "vessel_id").select("vessel_id", "id", "vessel_status")


@query("q46_change_log", """SELECT vessel_id, old_value, new_value, changed_at FROM (SELECT user_id AS vessel_id, lag(event_type) OVER w AS old_value, event_type AS new_value, ts AS changed_at, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n > 1 AND old_value IS DISTINCT FROM new_value""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.change_log(A.vessel_events(spark, sf_dir), "vessel_id", "vessel_status")


@query("q47_route_distance", f"""WITH n AS ({_NODES}), p AS (SELECT id % 10 AS route_id, CAST(id / 10 AS BIGINT) AS sequence, id AS node_id, latitude, longitude FROM (SELECT *, id - id % 10 AS base FROM n)),
q AS (SELECT route_id, (node_id - node_id % 10) // 10 AS sequence, node_id, latitude, longitude FROM p), l AS (SELECT *, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo FROM q WINDOW w AS (PARTITION BY route_id ORDER BY sequence)),
k AS (SELECT route_id, sequence, node_id, coalesce(power(sin(radians(latitude - la) / 2), 2) + cos(radians(la)) * cos(radians(latitude)) * power(sin(radians(longitude - lo) / 2), 2), 0) AS a FROM l)
SELECT route_id, sequence, node_id, CAST(sum(6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a))) OVER (PARTITION BY route_id ORDER BY sequence) AS DECIMAL(12,2)) AS distance_from_start FROM k""", plain="distance_from_start")
def route_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from the start along each route."""
    n = A.nodes(spark, sf_dir)
    path = n.select(F.pmod("id", F.lit(10)).alias("route_id"), F.floor(F.col("id") / 10).alias("sequence"), F.col("id").alias("node_id"))
    return routes.distances(path, n).select("route_id", "sequence", "node_id", F.col("distance_from_start").cast("decimal(12,2)").alias("distance_from_start"))


@query("q48_replace_children", """SELECT l_orderkey AS route_id, l_partkey AS node_id FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT DISTINCT l_orderkey, CAST(-1 AS BIGINT) FROM lineitem WHERE l_orderkey % 10 = 0""")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some routes get a new path; the others keep theirs."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_partkey").alias("node_id"))
    new = li.where(F.pmod("route_id", F.lit(10)) == 0).select("route_id").distinct().withColumn("node_id", F.lit(-1).cast("long"))
    return routes.replace_path(li, new)


@query("q49_top_per_day", """SELECT stat_date, node_id, value FROM (SELECT CAST(l_shipdate AS DATE) AS stat_date, l_suppkey AS node_id, count(*) AS value, row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY count(*) DESC, l_suppkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 3""", plain="stat_date")
def top_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three leading nodes of every day."""
    h = _origin(spark, sf_dir).select("stat_date", "node_id", F.col("cargo_count").alias("value"))
    return R.top_per_key(h, ["stat_date"], [F.desc("value"), F.asc("node_id")], 3)


@query("q50_snapshot", """SELECT DATE '1998-06-15' AS stat_date, l_suppkey AS node_id, count(*) AS cargo_count FROM lineitem GROUP BY 2""", plain="stat_date")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's other mode: all cargo so far, under one date."""
    return stats.cargo_heatmap(A.opportunities(spark, sf_dir), "origin_node_id", "CARGO_ORIGIN", mode="snapshot", target_date=DAY).select("stat_date", "node_id", "cargo_count")


@query("q51_update_rows", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 9 WHEN s_acctbal >= 0 THEN 1 ELSE 0 END AS status FROM supplier WHERE s_suppkey % 11 <> 0""")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed fields, then deleted rows."""
    n = A.nodes(spark, sf_dir).select("id", "name", "status")
    changed = n.where(F.pmod("id", F.lit(3)) == 0).select("id", F.upper("name").alias("name"), F.lit(9).alias("status"))
    return changes.delete_rows(changes.update_rows(n, changed, ["id"]), n.where(F.pmod("id", F.lit(11)) == 0), ["id"])


_DICTIONARY = f"""SELECT n.id, any_value(name) AS name, list(alias_name ORDER BY a.id) AS aliases FROM ({_NODES}) n JOIN ({_ALIASES}) a ON node_id = n.id GROUP BY 1"""
_MESSAGES = r"""SELECT id, regexp_extract(c, '([^\s,.]+?)(?:到|至|->|→)', 1) AS origin_text, regexp_extract(c, '(?:到|至|->|→)([^\s,.\d]+)', 1) AS dest_text, regexp_extract(c, '吨([^\s,.\d]+)', 1) AS commodity_text, CAST(regexp_extract(replace(regexp_extract(c, '\d[\d,.]*\s*千吨'), ',', ''), '[\d.]+') AS DOUBLE) * 1000 AS tonnage
FROM (SELECT o_orderkey AS id, 'Supplier#' || lpad(CAST(o_custkey % 100 AS VARCHAR), 9, '0') || '到S' || o_orderkey % 100 || ',' || o_orderkey % 9 || '千吨red widget' AS c FROM orders)"""


def message() -> Column:
    """The text of an order as a message: node by name, node by alias, tonnage and goods."""
    return F.concat(F.lit("Supplier#"), F.lpad(F.pmod("customer_id", F.lit(100)).cast("string"), 9, "0"), F.lit("到S"), F.pmod("id", F.lit(100)).cast("string"), F.lit("，"), F.pmod("id", F.lit(9)).cast("string"), F.lit("千吨red widget"))


@query("q52_parse_messages", f"""WITH m AS MATERIALIZED ({_MESSAGES}), ends AS MATERIALIZED ({_entity_matches("SELECT origin_text AS text FROM m UNION ALL SELECT dest_text FROM m", _DICTIONARY, 1)}), goods AS MATERIALIZED ({_entity_matches("SELECT commodity_text AS text FROM m", _GOODS, 1)})
SELECT m.id, o.id AS origin_id, d.id AS dest_id, g.id AS commodity_id, tonnage, CAST((coalesce(o.score, 0) + coalesce(d.score, 0) + coalesce(g.score, 0)) // 3 AS INTEGER) AS overall_confidence, 'PENDING_CONFIRM' AS parse_status
FROM m LEFT JOIN ends o ON o.text = origin_text LEFT JOIN ends d ON d.text = dest_text LEFT JOIN goods g ON g.text = commodity_text""")
def parse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made of node and part names, parsed and linked."""
    n = match.dictionary(A.nodes(spark, sf_dir), A.node_aliases(spark, sf_dir), "node_id")
    o = A.orders(spark, sf_dir)
    out = parsing.parse_messages(o.select("id", message().alias("raw_text")), n, _goods(spark, sf_dir))
    return out.select("id", "origin_id", "dest_id", "commodity_id", "tonnage", "overall_confidence", "parse_status")


@query("q53_parse_status", """SELECT o_orderkey AS id, CAST(count(l_linenumber) AS BIGINT) AS parse_count, coalesce(string_agg(l_returnflag || CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_returnflag), '') AS results FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their parse results and the number of these, also where there is none."""
    messages = A.orders(spark, sf_dir).select("id")
    out = R.nested(messages, table(spark, sf_dir, "lineitem"), "id", "l_orderkey", ["l_linenumber", "l_returnflag"], "results")
    shown = F.transform("results", lambda r: F.concat(r["l_returnflag"], r["l_linenumber"].cast("string")))
    return out.select("id", F.size("results").cast("long").alias("parse_count"), F.array_join(shown, ",").alias("results"))


@query("q54_audit_list", f"""SELECT id, target_type, submitter_id, (SELECT count(*) FROM ({_AUDIT}) WHERE audit_result = 'PENDING' AND target_type = 'NODE') AS total FROM ({_AUDIT}) WHERE audit_result = 'PENDING' AND target_type = 'NODE' ORDER BY created_at DESC, id DESC LIMIT 20""")
def audit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of pending records of a type, newest first; an empty submitter is no filter."""
    a = A.audit_records(spark, sf_dir).where(R.equal_filters("falsy", audit_result="PENDING", target_type="NODE", submitter_id=0))
    return R.page_with_total(a, [F.desc("created_at"), F.desc("id")], 1, 20).select("id", "target_type", "submitter_id", "total")


@query("q55_max_sibling_code", """SELECT n_regionkey AS parent_id, max(printf('%02d-02-%03d', n_regionkey + 1, n_nationkey + 1)) AS max_code FROM nation GROUP BY 1""")
def max_sibling_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest code among the children of each parent."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent_id"), F.format_string("%02d-02-%03d", F.col("n_regionkey") + 1, F.col("n_nationkey") + 1).alias("code"))
    return n.groupBy("parent_id").agg(F.max("code").alias("max_code"))


@query("q56_lookup", """SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = 77""")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its key; the filter reaches the scan."""
    return A.orders(spark, sf_dir).where(R.equal_filters(id=77)).select("id", "status")


@query("q57_foreign_keys", """SELECT l_orderkey AS order_id, l_suppkey AS node_id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)""")
def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose node is not among the active ones."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("node_id"))
    return changes.absent(rows, A.nodes(spark, sf_dir).where("status = 1").select(F.col("id").alias("node_id")), ["node_id"]).select("order_id", "node_id")


_NODE_ROWS = f"""SELECT n.id, name, alias_name AS matched, priority, 0 AS kind, a.id AS ord FROM ({_NODES}) n JOIN ({_ALIASES}) a ON node_id = n.id WHERE n.status = 1 AND a.status = 1 UNION ALL SELECT id, name, name, 5, 1, id FROM ({_NODES}) WHERE status = 1"""
_BLEND = "CASE WHEN {0}.id IS NULL THEN {1} ELSE ({1} + {0}.score) // 2 END"


@query("q58_parse_blended", f"""WITH m AS MATERIALIZED (SELECT o_orderkey AS id, 'Supplier#' || lpad(CAST(o_custkey % 100 AS VARCHAR), 9, '0') AS origin_text, 'S' || o_orderkey % 100 AS dest_text, CASE WHEN o_orderkey % 5 <> 0 THEN 'red widget' END AS commodity_text, o_orderkey * 3 % 101 AS oe, o_orderkey * 5 % 101 AS de, o_orderkey * 7 % 101 AS ce, o_orderkey * 11 % 101 AS te FROM orders),
ends AS MATERIALIZED ({_name_matches("SELECT origin_text AS text FROM m UNION ALL SELECT dest_text FROM m", _NODE_ROWS, 1)}), goods AS MATERIALIZED ({_name_matches("SELECT commodity_text AS text FROM m", _NAMED_ROWS, 1)}),
c AS (SELECT m.id, te, o.id AS origin_id, d.id AS dest_id, g.id AS commodity_id, CAST({_BLEND.format("o", "oe")} AS INTEGER) AS origin_confidence, CAST({_BLEND.format("d", "de")} AS INTEGER) AS dest_confidence, CAST({_BLEND.format("g", "ce")} AS INTEGER) AS commodity_confidence FROM m LEFT JOIN ends o ON o.text = origin_text LEFT JOIN ends d ON d.text = dest_text LEFT JOIN goods g ON g.text = commodity_text)
SELECT * EXCLUDE (te), CAST((origin_confidence + dest_confidence + commodity_confidence + te) // 4 AS INTEGER) AS overall_confidence, CASE WHEN id % 9 <> 0 THEN (id % 9) || '.0' END AS tonnage_text, 'PENDING_CONFIRM' AS parse_status FROM c""")
def parse_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older pipeline over orders: both ends and the goods matched by the second matcher, confidences blended."""
    n = A.nodes(spark, sf_dir)
    goods, goods_aliases = _named_goods(spark, sf_dir)
    i = F.col("id")
    score = lambda k: F.pmod(i * k, F.lit(101)).cast("int")
    texts = {
        "origin_text": F.concat(F.lit("Supplier#"), F.lpad(F.pmod("customer_id", F.lit(100)).cast("string"), 9, "0")),
        "dest_text": F.concat(F.lit("S"), F.pmod(i, F.lit(100)).cast("string")),
        "commodity_text": F.when(F.pmod(i, F.lit(5)) != 0, "red widget"),
        "tonnage": F.pmod(i, F.lit(9)).cast("double"),
        "origin_extracted": score(3), "dest_extracted": score(5), "commodity_extracted": score(7), "tonnage_extracted": score(11),
    }
    out = parsing.parse_blended(A.orders(spark, sf_dir).select("id", "customer_id"), n, A.node_aliases(spark, sf_dir), goods, goods_aliases.withColumnRenamed("entity_id", "commodity_id"), lambda m: m.withColumns(texts))
    return out.select("id", "origin_id", "dest_id", "commodity_id", "origin_confidence", "dest_confidence", "commodity_confidence", "overall_confidence", "tonnage_text", "parse_status")


@query("q59_commodity_aliases", f"""WITH {_NAMED} SELECT al.id AS alias_id, alias_name, e.id AS commodity_id, e.name FROM al JOIN e ON al.entity_id = e.id""")
def commodity_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active aliases of active goods."""
    goods, aliases = _named_goods(spark, sf_dir)
    e = goods.where("status = 1").select(F.col("id").alias("commodity_id"), "name")
    return aliases.where("status = 1").select(F.col("id").alias("alias_id"), "alias_name", F.col("entity_id").alias("commodity_id")).join(e, "commodity_id").select("alias_id", "alias_name", "commodity_id", "name")


@query("q60_code_and_name", """SELECT p_partkey AS id, p_name AS name, p_brand AS code FROM part WHERE p_name ILIKE '%gear%' AND p_brand = (SELECT min(p_brand) FROM part WHERE p_brand LIKE 'Brand#1%')""")
def code_and_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact code next to a name that contains a word; the code is looked up first."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("code"))
    code = p.where(F.col("code").startswith("Brand#1")).agg(F.min("code")).first()[0]
    return p.where(R.keyword(["name"], "gear") & R.equal_filters(code=code))


@query("q61_page_id_desc", f"""SELECT id, name, status, (SELECT count(*) FROM ({_NODES}) WHERE status = 1) AS total FROM ({_NODES}) WHERE status = 1 ORDER BY id DESC LIMIT 20 OFFSET 20""")
def page_id_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of active nodes, the newest ids first."""
    return R.page_with_total(A.nodes(spark, sf_dir).where("status = 1"), [F.desc("id")], 2, 20).select("id", "name", "status", "total")


@query("q62_alias_search_page", f"""WITH f AS (SELECT id, name FROM ({_NODES}) n WHERE name ILIKE '%1%' OR id IN (SELECT node_id FROM ({_ALIASES}) a WHERE alias_name ILIKE '%1%')) SELECT id, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 10 OFFSET 10""")
def alias_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the nodes that a word finds by name or alias, by id."""
    return R.page_with_total(R.by_name_or_alias(A.nodes(spark, sf_dir), A.node_aliases(spark, sf_dir), "1"), [F.asc("id")], 2, 10).select("id", "name", "total")


@query("q63_pending_for_target", f"""SELECT id, target_type, submitter_id FROM ({_AUDIT}) WHERE target_type = 'NODE' AND submitter_id = 7 AND audit_result = 'PENDING' ORDER BY id DESC LIMIT 1""")
def pending_for_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pending record of one target, here known by its submitter."""
    a = A.audit_records(spark, sf_dir).withColumn("target_id", F.col("submitter_id"))
    return governance.pending_for(a, "NODE", 7).select("id", "target_type", "submitter_id")


_DIRECT = """SELECT s_suppkey AS id, n, CAST(s_nationkey AS BIGINT) AS submitter_id, CASE (s_suppkey + n) % 4 WHEN 0 THEN 'REJECT' WHEN 1 THEN 'APPROVE' WHEN 2 THEN 'LATER' END AS decision, CAST((s_suppkey + n) % 25 AS BIGINT) AS auditor, CASE (s_suppkey + n) % 5 WHEN 0 THEN 'SUPER_ADMIN' WHEN 1 THEN 'VIEWER' ELSE 'ADMIN' END AS role FROM supplier, (SELECT unnest([0, 1, 2]) AS n)"""


@query("q64_direct_decisions", f"""WITH w AS (SELECT id, arg_max(decision, n) AS decision FROM ({_DIRECT}) WHERE decision IN ('APPROVE', 'REJECT') AND role <> 'VIEWER' AND NOT (auditor = submitter_id AND role <> 'SUPER_ADMIN') GROUP BY 1)
SELECT s_suppkey AS id, CAST(CASE decision WHEN 'APPROVE' THEN 1 WHEN 'REJECT' THEN 2 ELSE 0 END AS INTEGER) AS audit_status FROM supplier LEFT JOIN w ON id = s_suppkey""")
def direct_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes approved or rejected directly, three times each, none by those who submitted them."""
    n = A.nodes(spark, sf_dir).select("id", F.col("waterway_id").alias("submitter_id"), F.lit(0).alias("audit_status"))
    asked = n.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    i = F.col("id") + F.col("n")
    role = F.when(i % 5 == 0, "SUPER_ADMIN").when(i % 5 == 1, "VIEWER").otherwise("ADMIN")
    at = F.lit(datetime.datetime(2024, 1, 1)) + F.make_dt_interval(hours=F.col("n"))
    d = asked.select("id", F.when(i % 4 == 0, "REJECT").when(i % 4 == 1, "APPROVE").when(i % 4 == 2, "LATER").alias("decision"), F.pmod(i, F.lit(25)).alias("auditor_id"), F.array(role).alias("roles"), F.lit("ok").alias("remark"), at.alias("decided_at"))
    return governance.decide_directly(n, d, "NODE")[0].select("id", "audit_status")


@query("q65_audit_log", """SELECT s_suppkey AS target_id, 'NODE' AS target_type, 'UPDATE' AS action, '{"id":' || s_suppkey || ',"status":' || CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END || '}' AS before_data, '{"id":' || s_suppkey || ',"status":9}' AS after_data, 'PENDING' AS audit_result, CAST(3 AS BIGINT) AS submitter_id FROM supplier WHERE s_suppkey % 3 = 0""")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit records that a change of rows leaves, those that it didn't touch leaving none."""
    n = A.nodes(spark, sf_dir).select("id", "status")
    after = n.withColumn("status", F.when(F.pmod("id", F.lit(3)) == 0, 9).otherwise(F.col("status")))
    out = governance.snapshots(n, after, "id", "NODE", "UPDATE", F.lit(3).cast("long"), F.current_timestamp())
    return out.select("target_id", "target_type", "action", "before_data", "after_data", "audit_result", "submitter_id")


@query("q66_number_texts", """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 7 AS VARCHAR) END AS number_text, CAST(trunc(CAST(p_partkey % 97 AS DOUBLE) / 97 * 100) AS INTEGER) AS percent FROM part""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text, zero as null; shares in percent, cut to whole numbers."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return p.select("id", X.text_or_null(F.pmod("id", F.lit(7))).alias("number_text"), X.percent_truncated(F.pmod("id", F.lit(97)).cast("double") / 97).alias("percent"))


@query("q67_one_result_each", """SELECT l_orderkey AS raw_message_id, min(l_linenumber) AS result FROM lineitem GROUP BY 1""")
def one_result_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one result of each message: the first."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("raw_message_id"), F.col("l_linenumber").alias("result"))
    return R.top_per_key(li, ["raw_message_id"], [F.asc("result")], 1)


@query("q46b_change_log_in_slices", """SELECT vessel_id, old_value, new_value, changed_at FROM (SELECT user_id % 3 AS vessel_id, lag(event_type) OVER w AS old_value, event_type AS new_value, ts AS changed_at, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY ts, event_id)) WHERE n > 1 AND old_value IS DISTINCT FROM new_value""")
def change_log_in_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of three vessels with a third of all reports each, in slices of time."""
    e = A.vessel_events(spark, sf_dir).withColumn("vessel_id", F.pmod("vessel_id", F.lit(3)))
    return governance.change_log(e, "vessel_id", "vessel_status", slice_rows=1000)


@query("q47b_running_totals", """SELECT event_id AS id, event_type AS vessel_status, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM events""")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums over a few keys that have all reports, in slices of time."""
    e = A.vessel_events(spark, sf_dir).select("id", "vessel_status", "vessel_id", "ts")
    return ordered.running_sum(e, ["vessel_status"], ["ts", "id"], F.col("vessel_id"), "so_far", slice_rows=1000).select("id", "vessel_status", "so_far")


@query("q68_page_after", f"""SELECT id, target_type, created_at FROM ({_AUDIT}) ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40""")
def page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of records, newest first, each by the cursor of the page before."""
    a, order, cursor = A.audit_records(spark, sf_dir), [("created_at", True), ("id", True)], None
    for _ in range(2):
        cursor = R.cursor_of(R.page_after(a, order, cursor, 20), order)
    return R.page_after(a, order, cursor, 20).select("id", "target_type", "created_at")


@query("q69_search_by_grams", """SELECT 'EAR' AS word, p_partkey AS id FROM part WHERE p_name ILIKE '%EAR%' OR p_brand ILIKE '%EAR%' UNION ALL SELECT 'red%d_et', p_partkey FROM part WHERE p_name ILIKE '%red%d_et%' OR p_brand ILIKE '%red%d_et%'
UNION ALL SELECT 'rand#1', p_partkey FROM part WHERE p_name ILIKE '%rand#1%' OR p_brand ILIKE '%rand#1%' UNION ALL SELECT 'e', p_partkey FROM part WHERE p_name ILIKE '%e%' OR p_brand ILIKE '%e%'""")
def search_by_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords by the postings of trigrams; wildcards cut a word into literal runs, and one without a trigram meets all rows."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    posted = search.postings(p, ["name", "brand"])
    found = [search.search(p, posted, ["name", "brand"], w).select(F.lit(w).alias("word"), "id") for w in ("EAR", "red%d_et", "rand#1", "e")]
    return reduce(DataFrame.unionByName, found)


@query("q70_new_ids", """WITH t AS (SELECT max(o_orderkey) AS top FROM orders) SELECT l_returnflag AS flag, count(*) AS n, (SELECT top FROM t) AS below, (SELECT top + count(*) FROM t, lineitem GROUP BY top) AS upto, count(*) AS ids FROM lineitem GROUP BY 1""")
def new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered after the largest order: no number twice, none left out, none at or below the old ones."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    lines = table(spark, sf_dir, "lineitem").select(F.lit(None).cast("long").alias("id"), F.col("l_returnflag").alias("flag"))
    made = changes.with_new_ids(lines, old)
    ends = made.agg((F.min("id") - 1).alias("below"), F.max("id").alias("upto"))
    dealt = made.repartition(ordered.slices(lines), "id")  # by number, so that a task holds as many ids at any size
    return dealt.groupBy("flag").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).crossJoin(F.broadcast(ends))  # one row


@query("q53b_children_in_parts", """WITH l AS (SELECT l_returnflag AS flag, l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1) // 500 AS part FROM lineitem)
SELECT flag, CAST(part AS INTEGER) AS part, count(*) AS n, string_agg(l_orderkey || '-' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) AS lines FROM l GROUP BY ALL""")
def children_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few parents with very many children: arrays of 500 at most, in order across the parts."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber")
    out = R.nested_parts(li.select("flag").distinct(), li, "flag", "flag", ["l_orderkey", "l_linenumber"], "lines", size=500, slice_rows=10_000)
    shown = F.transform("lines", lambda r: F.concat_ws("-", r["l_orderkey"].cast("string"), r["l_linenumber"].cast("string")))
    return out.select("flag", "part", F.size("lines").cast("long").alias("n"), F.array_join(shown, ",").alias("lines"))


@query("q71_dictionary", f"""SELECT n.id, name, coalesce(string_agg(alias_name, '|' ORDER BY a.id), '') AS aliases FROM ({_NODES}) n LEFT JOIN ({_ALIASES}) a ON node_id = n.id AND n.id % 4 <> 0 GROUP BY ALL""")
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes with their aliases in the order of these' ids; some have none."""
    a = A.node_aliases(spark, sf_dir).where(F.pmod("node_id", F.lit(4)) != 0)
    return match.dictionary(A.nodes(spark, sf_dir), a, "node_id").select("id", "name", F.array_join("aliases", "|").alias("aliases"))


@query("q72_candidates", f"""SELECT text, arg_min(id, rank) AS matched_id, arg_min(score, rank) AS confidence, string_agg(id || ':' || name || ':' || score, '|' ORDER BY rank) AS candidates FROM ({_entity_matches(_ASKED, _GOODS)}) GROUP BY 1""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a text: the best entity, its confidence, and the ranked candidates as records of id, name and score."""
    c = match.candidates(match.match_entities(_asked(spark, sf_dir), _goods(spark, sf_dir)))
    shown = F.transform("candidates", lambda r: F.concat_ws(":", r["id"].cast("string"), r["name"], r["score"].cast("string")))
    return c.select("text", "matched_id", "confidence", F.array_join(shown, "|").alias("candidates"))


@query("q73_enable_disable", f"""SELECT id, CAST(CASE WHEN id % 5 = 0 THEN 1 WHEN id % 3 = 0 THEN 0 ELSE status END AS INTEGER) AS status FROM ({_NODES})""")
def enable_disable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes disabled by id, then some enabled."""
    n = A.nodes(spark, sf_dir).select("id", "status")
    off, on = n.where(F.pmod("id", F.lit(3)) == 0), n.where(F.pmod("id", F.lit(5)) == 0)
    return governance.set_status(governance.set_status(n, off, False), on.unionByName(on), True)


@query("q74_message_states", """WITH m AS (SELECT o_orderkey AS id, ['PENDING', 'PARSING', 'PARSED', 'PARSE_FAILED', 'INVALID'][o_orderkey % 5 + 1] AS s, o_orderdate FROM orders),
a AS (SELECT id, CASE WHEN s = 'PARSING' AND o_orderdate < TIMESTAMP '1998-06-14 23:00:00' THEN 'PENDING' ELSE s END AS swept FROM m), b AS (SELECT *, CASE WHEN id % 4 = 0 AND swept <> 'PARSING' THEN 'PENDING' ELSE swept END AS asked FROM a)
SELECT *, CASE WHEN id % 12 = 0 THEN 'PARSE_FAILED' WHEN id % 6 = 0 THEN 'PARSED' ELSE asked END AS status FROM b""")
def message_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of messages after a sweep of stale ones, requests to parse again, and the results of a batch."""
    states = F.array(*map(F.lit, ("PENDING", "PARSING", "PARSED", "PARSE_FAILED", "INVALID")))
    m = A.orders(spark, sf_dir).select("id", F.get(states, F.pmod("id", F.lit(5)).cast("int")).alias("status"), F.col("created_at").alias("updated_at"))
    wanted = m.select("id").where(F.pmod("id", F.lit(4)) == 0)
    results = m.where(F.pmod("id", F.lit(6)) == 0).select("id", F.when(F.pmod("id", F.lit(12)) == 0, "PARSE_FAILED").otherwise("PENDING_CONFIRM").alias("parse_status"))
    swept = governance.stale_reset(m, datetime.datetime(1998, 6, 15)).withColumn("swept", F.col("status"))
    asked = governance.request_reparse(swept, wanted).withColumn("asked", F.col("status"))
    return parsing.after_parse(asked, results).select("id", "swept", "asked", "status")


@query("q75_approved_aliases", f"""WITH j AS ({_JUDGED}), w AS (SELECT id, arg_min(decision, n) AS decision FROM j WHERE refusal IS NULL GROUP BY 1)
SELECT s_suppkey AS node_id, s_name AS alias_name, 'SYSTEM' AS alias_type, CAST(100 AS INTEGER) AS priority, CAST(1 AS INTEGER) AS status FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey IN (SELECT submitter_id FROM ({_AUDIT}) a JOIN w USING (id) WHERE decision = 'APPROVE' AND target_type = 'NODE')""")
def approved_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system aliases that approvals of nodes lead to, but for nodes that have theirs; the target is known by its submitter."""
    a = A.audit_records(spark, sf_dir).withColumn("target_id", F.col("submitter_id"))
    have = A.node_aliases(spark, sf_dir).where(F.pmod("node_id", F.lit(3)) == 0).withColumn("alias_type", F.lit("SYSTEM"))
    return governance.approve_nodes(a, _decisions(spark, sf_dir), A.nodes(spark, sf_dir), have)[1]


@query("q76_manual_entries", f"""WITH r AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS o, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey % 120 END AS d FROM lineitem), n AS (SELECT id FROM ({_NODES}) WHERE status = 1),
k AS (SELECT *, o IN (SELECT id FROM n) AND (d IS NULL OR d IN (SELECT id FROM n)) AS ok FROM r) SELECT order_id, line, o AS origin_node_id, d AS dest_node_id, CASE WHEN ok THEN 'PENDING' END AS status, CASE WHEN ok THEN 'MANUAL' END AS input_type FROM k""")
def manual_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual entries, accepted ones waiting and the others without a state: an end that is given must be an active node."""
    dest = F.when(F.pmod("l_partkey", F.lit(4)) != 0, F.pmod("l_partkey", F.lit(120)))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("origin_node_id"), dest.alias("dest_node_id"))
    accepted, rejected = parsing.manual_opportunities(rows, A.nodes(spark, sf_dir).where("status = 1"))
    return accepted.unionByName(rejected, allowMissingColumns=True)


@query("q77_violations", """WITH m AS (SELECT CASE WHEN event_id % 7 <> 0 THEN CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'PARSED' ELSE upper(event_type) END END AS status FROM events),
a AS (SELECT CASE WHEN user_id % 10 <> 0 THEN 'n' || user_id END AS alias_name FROM events), h AS (SELECT CAST(ts AS DATE) AS d, CASE WHEN user_id % 50 <> 0 THEN user_id END AS n, CASE WHEN event_type = 'error' THEN 'OTHER' ELSE 'VESSEL' END AS t FROM events),
v AS (SELECT 'cargo_raw_message' AS name, 'status in set' AS rule, count(*) AS n FROM m WHERE status NOT IN ('PENDING', 'PARSING', 'PARSED', 'PARSE_FAILED', 'INVALID')
UNION ALL SELECT 'node_alias', 'key not null', count(*) FROM a WHERE alias_name IS NULL UNION ALL SELECT 'node_alias', 'key unique', count(*) FROM (SELECT alias_name FROM a GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'heatmap_stat_daily', 'stat_type in set', count(*) FROM h WHERE t = 'OTHER' UNION ALL SELECT 'heatmap_stat_daily', 'key not null', count(*) FROM h WHERE n IS NULL
UNION ALL SELECT 'heatmap_stat_daily', 'key unique', count(*) FROM (SELECT d, n, t FROM h GROUP BY ALL HAVING count(*) > 1)) SELECT * FROM v WHERE n > 0""")
def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and keys that break the rules of three tables, by rule."""
    e = table(spark, sf_dir, "events")
    kind, user = F.col("event_type"), F.col("user_id")
    made = {
        "cargo_raw_message": e.select(F.when(F.pmod("event_id", F.lit(7)) != 0, F.when(kind == "view", "PENDING").when(kind == "click", "PARSED").otherwise(F.upper(kind))).alias("status")),
        "node_alias": e.select(F.when(F.pmod(user, F.lit(10)) != 0, F.concat(F.lit("n"), user.cast("string"))).alias("alias_name")),
        "heatmap_stat_daily": e.select(F.to_date("ts").alias("stat_date"), F.when(F.pmod(user, F.lit(50)) != 0, user).alias("node_id"), F.when(kind == "error", "OTHER").otherwise("VESSEL").alias("stat_type")),
    }
    found = [schemas.violations(schemas.conform(df, name), name).select(F.lit(name).alias("name"), "rule", "n") for name, df in made.items()]
    return reduce(DataFrame.unionByName, found)


@query("q78_sql_functions", f"""WITH RECURSIVE s AS (SELECT id, lower(name) AS n, 'supplier' || id AS short, latitude AS la, longitude AS lo FROM ({_NODES})), {_ratios("SELECT n AS a, short AS b FROM s")},
h AS (SELECT *, 6371.0::DOUBLE * 2 * atan2(sqrt(x), sqrt(1 - x)) AS km FROM (SELECT *, power(sin(radians(31.5::DOUBLE - la) / 2), 2) + cos(radians(la)) * cos(radians(31.5::DOUBLE)) * power(sin(radians(117.25::DOUBLE - lo) / 2), 2) AS x FROM s))
SELECT id, CAST(round(km * 100) AS BIGINT) AS km_100, CAST(round(km * 150) AS BIGINT) AS river_100, CAST(trunc(r * 100) AS INTEGER) AS likeness, CAST(id || '000' AS DOUBLE) AS tons, CASE WHEN id % 2 = 0 THEN '138' || lpad(CAST(id AS VARCHAR), 8, '0') END AS phone FROM h JOIN ratio ON a = n AND b = short""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions as SQL knows them."""
    X.register(spark)
    text = """SELECT id, CAST(round(haversine_km(latitude, longitude, 31.5D, 117.25D) * 100) AS BIGINT) AS km_100, CAST(round(waterway_km(haversine_km(latitude, longitude, 31.5D, 117.25D)) * 100) AS BIGINT) AS river_100,
              CAST(similarity_ratio(lower(name), concat('supplier', id)) * 100 AS INT) AS likeness, tonnage_of(concat(id, '千吨')) AS tons, phone_of(concat('tel ', if(id % 2 = 0, '138', '99'), lpad(CAST(id AS STRING), 8, '0'), '.')) AS phone FROM {n}"""
    return spark.sql(text, n=A.nodes(spark, sf_dir))


@query("q79_extract", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 'N' || o_orderkey % 100 END AS origin_text, CASE WHEN o_orderkey % 7 <> 0 THEN '港口' END AS dest_text, CASE WHEN o_orderkey % 7 <> 0 THEN '煤炭' END AS commodity_text,
CASE WHEN o_orderkey % 7 <> 0 THEN CAST((o_orderkey % 900 + 1) * [10000, 1000, 1][o_orderkey % 3 + 1] AS DOUBLE) END AS tonnage, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS loading_date, CASE WHEN o_orderkey % 7 <> 0 THEN '13' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS contact_phone FROM orders""")
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of messages by the default extractor; blank messages have none, and dates that don't exist are null."""
    i = F.col("id")
    unit = F.get(F.array(*map(F.lit, ("万吨", "千吨", "吨"))), F.pmod(i, F.lit(3)).cast("int"))
    day = F.when(F.pmod(i, F.lit(5)) == 0, "1998-13-40").otherwise(F.date_format("created_at", "yyyy-MM-dd"))
    text = F.concat(F.lit("N"), F.pmod(i, F.lit(100)), F.lit("到港口，"), F.pmod(i, F.lit(900)) + 1, unit, F.lit("煤炭  "), day, F.lit("\t电话13"), F.lpad(i.cast("string"), 9, "0"))
    m = A.orders(spark, sf_dir).select("id", F.when(F.pmod(i, F.lit(7)) != 0, text).otherwise(" 　 ").alias("raw_text"))
    return parsing.extract_by_rules(m).select("id", "origin_text", "dest_text", "commodity_text", "tonnage", F.col("loading_date").cast("string").alias("loading_date"), "contact_phone")


_RIVERS = ["运河", "北运河", "永定河", "松花江", "乌苏里江", "西江", "渭河", "淮河", "川"]


@query("q80_single_codes", """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN '05' ELSE ['08', '08', '07', '06', '05', '04', '03', '02', '01'][p_partkey % 9 + 1] END || '-' || CASE WHEN p_partkey % 3 = 2 THEN '03' WHEN p_partkey % 2 = 0 THEN '01' ELSE '02' END || '-' || ['001', '008', '001', '001', '1001'][p_partkey % 5 + 1] AS code,
CASE WHEN p_partkey % 4 = 1 THEN '05' WHEN contains(p_name, 'red') THEN '42' WHEN contains(p_name, 'blue') THEN '41' ELSE '00' END AS own_basin FROM part""")
def single_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of single rows: the basin by parent or name, the first that fits, the level, the number after the largest sibling's; and basins of one's own."""
    p, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.pmod(i, F.lit(len(values))).cast("int"))
    name, parent = F.concat("p_name", pick(_RIVERS)), pick([None, "05-02-003", "bad", None])
    made = codes.single_code(name, F.pmod(i, F.lit(3)) + 1, F.when(F.pmod(i, F.lit(2)) == 1, i), parent, pick([None, "01-02-007", "xx", "01-02-abc", "01-02-1000"]))
    return p.select(i.alias("id"), made.alias("code"), codes.basin(F.col("p_name"), parent, {"42": ["red"], "41": ["blue"]}, "00").alias("own_basin"))


@query("q81_stages", """WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'P') SELECT 'waiting' AS stage, count(*) AS n FROM o UNION ALL SELECT 'by customer', count(DISTINCT o_custkey) FROM o UNION ALL SELECT 'repeated', count(*) FROM (SELECT o_custkey FROM o GROUP BY 1 HAVING count(*) > 1)""")
def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline of three stages with the number of rows that each gave."""
    steps = [("waiting", lambda d: d.where("status = 'P'")), ("by customer", lambda d: d.groupBy("customer_id").count()), ("repeated", lambda d: d.where("count > 1"))]
    out = stages.run_stages(A.orders(spark, sf_dir), steps)
    return reduce(DataFrame.unionByName, [d.agg(F.lit(name).alias("stage"), F.count("*").alias("n")) for name, d in out.stages.items()])
