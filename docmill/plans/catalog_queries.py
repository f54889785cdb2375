"""Queries over the driver's tables, one or more per operator family, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Engine
from ..operators import search
from ..operators.columnar import Columnar
from ..sources.catalog import Catalog
from ..sources.checkpoints import own_folder
from ..streaming import streams

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

FLAGSHIP = """
    FOR l IN lineitem FILTER l.l_quantity > 30
    COLLECT f = l.l_returnflag, s = l.l_linestatus WITH COUNT INTO n
    AGGREGATE q = SUM(l.l_quantity), p = AVG(l.l_extendedprice), m = MAX(l.l_discount)
    SORT f, s RETURN {f, s, n, q: ROUND(q, 2), p: ROUND(p, 2), m}"""


def scratch(spark: SparkSession) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return own_folder(spark, "queries")


def engine(spark: SparkSession, sf_dir: str, writable: bool = False, flat: bool = False) -> Engine:
    return Engine(spark, Catalog.of_folder(spark, sf_dir, TABLES, scratch(spark) if writable else None), flat)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query(FLAGSHIP)


def _query(text: str, spark: SparkSession, sf_dir: str, flat: bool = False, binds: dict | None = None) -> DataFrame:
    return engine(spark, sf_dir, flat=flat).query(text, binds)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, text: str, sql: str | None, **options) -> None:
    QUERIES[name] = partial(_query, text, **options)
    if sql:
        ORACLE_SQL[name] = sql


def added(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


add("flagship", FLAGSHIP, """
    SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS p, max(l_discount) AS m
    FROM lineitem WHERE l_quantity > 30 GROUP BY ALL""")  # fmt: skip

# -- sources, projection, operators

add("scan_range_for", "FOR i IN 1..4 FOR j IN i..4 RETURN {i, j, p: i * j}", "SELECT i, j, CAST(i * j AS DOUBLE) AS p FROM range(1, 5) a(i), range(1, 5) b(j) WHERE j >= i")
add("scan_array_for", 'LET xs = ["a", "b", "c"] FOR x IN xs FOR n IN nation FILTER n.n_regionkey == 1 RETURN {x, n: n.n_name}', "SELECT x, n_name AS n FROM nation, unnest(['a', 'b', 'c']) t(x) WHERE n_regionkey = 1")
add("document_lookup", 'FOR s IN supplier LET n = FIRST((FOR x IN nation FILTER x.n_nationkey == s.s_nationkey RETURN x.n_name)) RETURN {k: s.s_suppkey, n}', "SELECT s_suppkey AS k, n_name AS n FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
add("collection_count", 'RETURN {c: COLLECTION_COUNT("customer"), o: COLLECTION_COUNT("orders")}', "SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o")
add("filter_null_order", """
    FOR c IN customer LET b = c.c_acctbal > 5000 ? c.c_acctbal : null FILTER b < 6000
    RETURN {k: c.c_custkey, b, missing: c.no_such_field == null}""", """
    SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS b, true AS missing FROM customer
    WHERE NOT (c_acctbal > 5000) OR c_acctbal < 6000""")  # fmt: skip
add("projection_template", """
    FOR p IN part RETURN {k: p.p_partkey, t: $"${p.p_brand}: ${p.p_size} of ${p.nothing}", d: p["p_" + "type"], c: CASE WHEN p.p_size < 10 THEN "small" WHEN p.p_size < 30 THEN "medium" ELSE "large" END,
      e: CASE p.p_size WHEN 1 THEN "one" ELSE null END, o: p?.p_name ?? "none"}""", """
    SELECT p_partkey AS k, p_brand || ': ' || p_size || ' of null' AS t, p_type AS d,
           CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c,
           CASE p_size WHEN 1 THEN 'one' END AS e, coalesce(p_name, 'none') AS o FROM part""")  # fmt: skip
add("operators_arithmetic", """
    FOR l IN lineitem RETURN {k: l.l_orderkey, n: l.l_linenumber, a: ROUND(l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax), 2), b: l.l_linenumber % 3, c: -l.l_linenumber,
      d: l.l_linenumber & 3, e: l.l_linenumber | 8, f: l.l_linenumber ^ 5, g: l.l_linenumber << 2, h: l.l_quantity / 4}""", """
    SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) AS a, CAST(l_linenumber % 3 AS DOUBLE) AS b, CAST(-l_linenumber AS DOUBLE) AS c,
      CAST(l_linenumber & 3 AS DOUBLE) AS d, CAST(l_linenumber | 8 AS DOUBLE) AS e, CAST(xor(l_linenumber, 5) AS DOUBLE) AS f, CAST(l_linenumber << 2 AS DOUBLE) AS g, l_quantity / 4 AS h FROM lineitem""")  # fmt: skip
add("operators_predicates", """
    FOR c IN customer FILTER c.c_mktsegment IN ["BUILDING", "MACHINERY", "AUTOMOBILE"] AND NOT (c.c_acctbal < 0) OR c.c_name LIKE "%7" OR c.c_name =~ "0{3}[12]$" OR c.c_mktsegment ~= "FURNITURA"
    RETURN {k: c.c_custkey, not_in: c.c_nationkey NOT IN [1, 2, 3], unlike: c.c_name NOT LIKE "%1%", ne: c.c_mktsegment != "BUILDING"}""", """
    SELECT c_custkey AS k, c_nationkey NOT IN (1, 2, 3) AS not_in, c_name NOT LIKE '%1%' AS unlike, c_mktsegment <> 'BUILDING' AS ne FROM customer
    WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND NOT (c_acctbal < 0)) OR c_name LIKE '%7' OR regexp_matches(c_name, '0{3}[12]$') OR levenshtein(c_mktsegment, 'FURNITURA') <= 2""")  # fmt: skip
add("bind_variables", "FOR o IN orders FILTER o.o_totalprice >= @low AND o.o_orderstatus == @status RETURN {k: o.o_orderkey, p: o.o_totalprice}",
    "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'O'", binds={"low": 150000, "status": "O"})
add("quantifiers", 'FOR n IN nation LET parts = SPLIT(n.n_name, "_") RETURN {k: n.n_nationkey, any1: ANY x IN parts SATISFIES x == "1", all1: ALL x IN parts SATISFIES LENGTH(x) > 0, none1: NONE x IN parts SATISFIES x == "NATION"}', """
    SELECT n_nationkey AS k, list_contains(string_split(n_name, '_'), '1') AS any1, len([x FOR x IN string_split(n_name, '_') IF len(x) = 0]) = 0 AS all1, NOT list_contains(string_split(n_name, '_'), 'NATION') AS none1 FROM nation""")  # fmt: skip

# -- grouping

add("collect_distinct", "FOR c IN customer COLLECT s = c.c_mktsegment, n = c.c_nationkey RETURN {s, n}", "SELECT DISTINCT c_mktsegment AS s, c_nationkey AS n FROM customer")
add("collect_count", "FOR o IN orders COLLECT p = o.o_orderpriority WITH COUNT INTO n FILTER n > 10 RETURN {p, n}", "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
add("collect_global", "FOR l IN lineitem COLLECT AGGREGATE s = SUM(l.l_quantity), a = AVG(l.l_discount), lo = MIN(l.l_shipdate), hi = MAX(l.l_returnflag), n = COUNT(), d = COUNT_DISTINCT(l.l_suppkey), u = LENGTH(l.l_partkey) RETURN {s, a: ROUND(a, 4), lo: DATE_FORMAT(lo, \"%Y-%m-%d\"), hi, n, d, u}", """
    SELECT sum(l_quantity) AS s, round(avg(l_discount), 4) AS a, strftime(min(l_shipdate), '%Y-%m-%d') AS lo, max(l_returnflag) AS hi, count(*) AS n, count(DISTINCT l_suppkey) AS d, count(DISTINCT l_partkey) AS u FROM lineitem""")  # fmt: skip
add("collect_empty", "FOR l IN lineitem FILTER l.l_quantity > 100000 COLLECT WITH COUNT INTO n RETURN n", "SELECT count(*) AS value FROM lineitem WHERE l_quantity > 100000 HAVING count(*) > 0")
add("collect_into_aggregates", "FOR o IN orders COLLECT s = o.o_orderstatus INTO g RETURN {s, n: LENGTH(g), t: ROUND(SUM(g[*].o.o_totalprice), 0), m: MAX(g[*].o.o_totalprice), c: COUNT_DISTINCT(g[*].o.o_custkey)}", """
    SELECT o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice), 0) AS t, max(o_totalprice) AS m, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1""")  # fmt: skip
add("collect_into_rows", 'FOR n IN nation COLLECT r = n.n_regionkey INTO g RETURN {r, names: JOIN(SORTED(g[*].n.n_name), "|")}', "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1")
add("collect_list", "FOR c IN customer COLLECT k = c.c_nationkey AGGREGATE l = COLLECT_LIST(c.c_custkey), v = VARIANCE(c.c_acctbal), d = STDDEV(c.c_acctbal), md = MEDIAN(c.c_acctbal) RETURN {k, n: LENGTH(l), s: SUM(l), v: ROUND(v, 2), d: ROUND(d, 2), md: ROUND(md, 2)}", """
    SELECT c_nationkey AS k, count(*) AS n, CAST(sum(c_custkey) AS DOUBLE) AS s, CASE WHEN count(*) > 1 THEN round(var_pop(c_acctbal), 2) END AS v, CASE WHEN count(*) > 1 THEN round(stddev_pop(c_acctbal), 2) END AS d, round(median(c_acctbal), 2) AS md FROM customer GROUP BY 1""")  # fmt: skip

# -- joins

add("join_array", "FOR c IN customer JOIN orders ON orders.o_custkey == c.c_custkey RETURN {k: c.c_custkey, n: LENGTH(orders), t: ROUND(SUM(orders[*].o_totalprice), 2)}", """
    SELECT c_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")  # fmt: skip
add("join_array_rows", 'FOR r IN region JOIN nation ON nation.n_regionkey == r.r_regionkey RETURN {r: r.r_name, names: JOIN(SORTED(nation[*].n_name), ","), first: SORTED(nation[*].n_name)[0]}', """
    SELECT r_name AS r, string_agg(n_name, ',' ORDER BY n_name) AS names, min(n_name) AS first FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")  # fmt: skip
add("join_left", "FOR c IN customer LEFT JOIN orders ON orders.o_custkey == c.c_custkey AND orders.o_totalprice > 100000 RETURN {k: c.c_custkey, n: LENGTH(orders), m: MAX(orders[*].o_totalprice)}", """
    SELECT c_custkey AS k, count(o_orderkey) AS n, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY 1""")  # fmt: skip
add("join_right", "FOR r IN region RIGHT JOIN nation ON nation.n_regionkey == r.r_regionkey RETURN {n: nation.n_name, r: r.r_name}", "SELECT n_name AS n, r_name AS r FROM region RIGHT JOIN nation ON n_regionkey = r_regionkey")
add("join_full", 'FOR s IN supplier FULL OUTER JOIN nation ON nation.n_nationkey == s.s_nationkey RETURN {k: s.s_suppkey, n: JOIN(nation[*].n_name, ",")}', "SELECT s_suppkey AS k, coalesce(n_name, '') AS n FROM supplier FULL JOIN nation ON n_nationkey = s_nationkey")
add("join_theta", "FOR n IN nation JOIN region ON region.r_regionkey < n.n_regionkey RETURN {k: n.n_nationkey, n: LENGTH(region), m: MAX(region[*].r_regionkey)}", """
    SELECT n_nationkey AS k, count(*) AS n, CAST(max(r_regionkey) AS DOUBLE) AS m FROM nation JOIN region ON r_regionkey < n_regionkey GROUP BY 1""")  # fmt: skip
add("join_chain", "FOR n IN nation JOIN customer ON customer.c_nationkey == n.n_nationkey LEFT JOIN supplier ON supplier.s_nationkey == n.n_nationkey RETURN {n: n.n_name, c: LENGTH(customer), s: LENGTH(supplier), b: ROUND(AVG(customer[*].c_acctbal), 2)}", """
    SELECT n_name AS n, c, coalesce(s, 0) AS s, b FROM nation JOIN (SELECT c_nationkey, count(*) AS c, round(avg(c_acctbal), 2) AS b FROM customer GROUP BY 1) x ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) y ON s_nationkey = n_nationkey""")  # fmt: skip
add("join_nested_for", "FOR c IN customer FOR o IN orders FILTER o.o_custkey == c.c_custkey AND o.o_totalprice > 200000 FOR n IN nation FILTER n.n_nationkey == c.c_nationkey COLLECT k = n.n_name WITH COUNT INTO m AGGREGATE t = SUM(o.o_totalprice) RETURN {k, m, t: ROUND(t, 2)}", """
    SELECT n_name AS k, count(*) AS m, round(sum(o_totalprice), 2) AS t FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")  # fmt: skip
add("join_flat", "FOR n IN nation LEFT JOIN supplier ON supplier.s_nationkey == n.n_nationkey RETURN {n: n.n_name, s: supplier.s_name}", "SELECT n_name AS n, s_name AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey", flat=True)
add("join_semi", "FOR c IN customer FILTER LENGTH((FOR o IN orders FILTER o.o_custkey == c.c_custkey AND o.o_totalprice > 250000 RETURN 1)) > 0 RETURN c.c_custkey", "SELECT c_custkey AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
add("join_anti", "FOR c IN customer FILTER c.c_custkey NOT IN (FOR o IN orders RETURN o.o_custkey) RETURN {k: c.c_custkey, s: c.c_mktsegment}", "SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")

# -- windows, sort, limit

add("window_rank", """
    FOR o IN orders RETURN {k: o.o_orderkey, rn: ROW_NUMBER() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey),
      r: RANK() OVER (PARTITION BY o.o_orderstatus ORDER BY o.o_orderpriority), d: DENSE_RANK() OVER (PARTITION BY o.o_orderstatus ORDER BY o.o_orderpriority DESC)}""", """
    SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r,
      dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC) AS d FROM orders""")  # fmt: skip
add("window_shift", """
    FOR o IN orders RETURN {k: o.o_orderkey, a: LAG(o.o_totalprice) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey), b: LEAD(o.o_totalprice, 2, -1) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey),
      f: FIRST_VALUE(o.o_orderkey) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey), l: LAST_VALUE(o.o_orderkey) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey)}""", """
    SELECT o_orderkey AS k, lag(o_totalprice) OVER w AS a, lead(o_totalprice, 2, -1) OVER w AS b, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f, max(o_orderkey) OVER (PARTITION BY o_custkey) AS l
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")  # fmt: skip
add("window_running", """
    FOR o IN orders RETURN {k: o.o_orderkey, s: ROUND(SUM(o.o_totalprice) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey), 2), a: ROUND(AVG(o.o_totalprice) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey), 2),
      c: COUNT(o.o_totalprice) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey), mi: MIN(o.o_totalprice) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey), ma: MAX(o.o_totalprice) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey)}""", """
    SELECT o_orderkey AS k, round(sum(o_totalprice) OVER w, 2) AS s, round(avg(o_totalprice) OVER w, 2) AS a, count(o_totalprice) OVER w AS c, min(o_totalprice) OVER w AS mi, max(o_totalprice) OVER w AS ma
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
add("sort_limit", "FOR o IN orders SORT o.o_totalprice DESC, o.o_orderkey LIMIT 5, 10 RETURN {k: o.o_orderkey, p: o.o_totalprice}", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")

# -- subqueries and sets

add("subquery_correlated", "FOR o IN orders LET q = SUM((FOR l IN lineitem FILTER l.l_orderkey == o.o_orderkey RETURN l.l_quantity)) LET n = LENGTH((FOR l IN lineitem FILTER l.l_orderkey == o.o_orderkey AND l.l_discount > 0.05 RETURN 1)) RETURN {k: o.o_orderkey, q, n}", """
    SELECT o_orderkey AS k, coalesce(sum(l_quantity), 0.0) AS q, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")  # fmt: skip
add("subquery_top_per_row", 'FOR c IN customer LET top = (FOR o IN orders FILTER o.o_custkey == c.c_custkey AND o.o_custkey != null SORT o.o_totalprice DESC LIMIT 2 RETURN o.o_orderkey) RETURN {k: c.c_custkey, top: JOIN(top, ",")}', """
    SELECT c_custkey AS k, coalesce(top, '') AS top FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC) AS top
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rn FROM orders) WHERE rn <= 2 GROUP BY 1) ON o_custkey = c_custkey""")  # fmt: skip
add("subquery_uncorrelated", "FOR n IN nation LET rs = (FOR r IN region SORT r.r_name RETURN r.r_name) RETURN {n: n.n_name, rs: JOIN(rs, \",\"), c: LENGTH(rs)}", "SELECT n_name AS n, (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) AS rs, (SELECT count(*) FROM region) AS c FROM nation")
add("subquery_grouped", "FOR c IN customer LET s = (FOR o IN orders FILTER o.o_custkey == c.c_custkey COLLECT st = o.o_orderstatus WITH COUNT INTO n SORT st RETURN CONCAT(st, n)) RETURN {k: c.c_custkey, s: JOIN(s, \"\")}", """
    SELECT c_custkey AS k, coalesce(s, '') AS s FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderstatus || n, '' ORDER BY o_orderstatus) AS s
    FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1) ON o_custkey = c_custkey""")  # fmt: skip
add("subquery_theta", "FOR n IN nation LET later = (FOR m IN nation FILTER m.n_name > n.n_name AND m.n_regionkey == n.n_regionkey RETURN m.n_nationkey) RETURN {k: n.n_nationkey, c: LENGTH(later), s: SUM(later)}", """
    SELECT n.n_nationkey AS k, count(m.n_nationkey) AS c, CAST(coalesce(sum(m.n_nationkey), 0) AS DOUBLE) AS s FROM nation n LEFT JOIN nation m ON m.n_name > n.n_name AND m.n_regionkey = n.n_regionkey GROUP BY 1""")  # fmt: skip
add("array_sets", 'FOR c IN customer LET a = [c.c_custkey % 3, c.c_custkey % 5] LET b = [c.c_custkey % 2, c.c_custkey % 5, 7] RETURN {k: c.c_custkey, u: LENGTH(UNION(a, b)), i: LENGTH(INTERSECTION(a, b)), m: LENGTH(MINUS(a, b)), q: LENGTH(UNIQUE(APPEND(a, b)))}', """
    SELECT k, len(list_distinct(list_concat(a, b))) AS u, len([x FOR x IN a IF list_contains(b, x)]) AS i, len([x FOR x IN a IF NOT list_contains(b, x)]) AS m, len(list_distinct(list_concat(a, b))) AS q
    FROM (SELECT c_custkey AS k, [c_custkey % 3, c_custkey % 5] AS a, [c_custkey % 2, c_custkey % 5, 7] AS b FROM customer)""")  # fmt: skip

# -- functions

add("functions_string", """
    FOR p IN part RETURN {k: p.p_partkey, a: UPPER(p.p_name), b: LOWER(p.p_brand), c: SUBSTRING(p.p_name, 2, 4), d: LEFT(p.p_type, 3), e: RIGHT(p.p_type, 3), f: LENGTH(p.p_name), g: CONTAINS(p.p_name, "a"), h: CONTAINS(p.p_name, "a", true),
      i: REPLACE(p.p_brand, "#", "-"), j: REVERSE(p.p_brand), l: CONCAT(p.p_brand, ":", p.p_size), m: CONCAT_WS("/", p.p_brand, p.p_type), n: STARTS_WITH(p.p_name, "P"), o: FIND_LAST(p.p_name, "a"), q: CAPITALIZE(LOWER(p.p_type)),
      r: TRIM($"  ${p.p_brand} "), s: LPAD(TO_STRING(p.p_size), 5, "0"), t: REPEAT("x", p.p_size % 4), u: SLUGIFY(p.p_type), v: WORD_COUNT(p.p_name), w: SPLIT(p.p_brand, "#")[1], x: REGEX_REPLACE(p.p_name, "[0-9]+", "N"), y: REGEX_TEST(p.p_type, "^S"), z: CHAR_LENGTH(p.p_type)}""", """
    SELECT p_partkey AS k, upper(p_name) AS a, lower(p_brand) AS b, substr(p_name, 3, 4) AS c, left(p_type, 3) AS d, right(p_type, 3) AS e, length(p_name) AS f, contains(p_name, 'a') AS g, CAST(instr(p_name, 'a') - 1 AS BIGINT) AS h,
      replace(p_brand, '#', '-') AS i, reverse(p_brand) AS j, p_brand || ':' || p_size AS l, p_brand || '/' || p_type AS m, starts_with(p_name, 'P') AS n, CASE WHEN contains(p_name, 'a') THEN length(p_name) - instr(reverse(p_name), 'a') ELSE -1 END AS o,
      upper(left(lower(p_type), 1)) || substr(lower(p_type), 2) AS q, p_brand AS r, lpad(CAST(p_size AS VARCHAR), 5, '0') AS s, repeat('x', p_size % 4) AS t, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS u,
      len([x FOR x IN string_split_regex(p_name, '\\s+') IF x <> '']) AS v, string_split(p_brand, '#')[2] AS w, regexp_replace(p_name, '[0-9]+', 'N', 'g') AS x, starts_with(p_type, 'S') AS y, length(p_type) AS z FROM part""")  # fmt: skip
add("functions_fuzzy", 'FOR p IN part RETURN {k: p.p_partkey, l: LEVENSHTEIN(p.p_brand, "Brand#12"), f: FUZZY_MATCH(p.p_brand, "Brand#12", 1), h: HIGHLIGHT(p.p_brand, "brand")}', """
    SELECT p_partkey AS k, levenshtein(p_brand, 'Brand#12') AS l, levenshtein(p_brand, 'Brand#12') <= 1 AS f, replace(p_brand, 'Brand', '<b>Brand</b>') AS h FROM part""")  # fmt: skip
add("functions_date", """
    FOR o IN orders RETURN {k: o.o_orderkey, y: DATE_YEAR(o.o_orderdate), m: DATE_MONTH(o.o_orderdate), d: DATE_DAY(o.o_orderdate), w: DATE_DAYOFWEEK(o.o_orderdate), q: DATE_QUARTER(o.o_orderdate), dy: DATE_DAYOFYEAR(o.o_orderdate), iw: DATE_ISOWEEK(o.o_orderdate), dm: DATE_DAYS_IN_MONTH(o.o_orderdate),
      t: DATE_TRUNC(o.o_orderdate, "month"), a: DATE_ADD(o.o_orderdate, 1, "month"), b: DATE_SUBTRACT(o.o_orderdate, 36, "hours"), f: DATE_FORMAT(o.o_orderdate, "%d.%m.%Y"), x: DATE_DIFF(o.o_orderdate, "1998-12-31T00:00:00Z", "days"), z: DATE_TIMESTAMP(o.o_orderdate)}""", """
    SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) AS w, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS dy, week(o_orderdate) AS iw, day(last_day(o_orderdate)) AS dm,
      strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT00:00:00.000Z') AS t, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%dT%H:%M:%S.000Z') AS a, strftime(o_orderdate - INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') AS b, strftime(o_orderdate, '%d.%m.%Y') AS f,
      CAST(trunc((epoch_ms(TIMESTAMP '1998-12-31') - epoch_ms(o_orderdate)) / 86400000.0) AS DOUBLE) AS x, epoch_ms(o_orderdate) AS z FROM orders""")  # fmt: skip
add("functions_bucket", 'FOR e IN events COLLECT b = TIME_BUCKET(e.ts, "1h"), t = e.event_type WITH COUNT INTO n AGGREGATE s = SUM(e.value) RETURN {b, t, n, s: ROUND(s, 2)}', """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00+00:00') AS b, event_type AS t, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1, 2""")  # fmt: skip
add("functions_math", """
    FOR c IN customer LET x = ABS(c.c_acctbal) RETURN {k: c.c_custkey, a: FLOOR(c.c_acctbal), b: CEIL(c.c_acctbal), c: ROUND(SQRT(x), 6), d: ROUND(LOG(x + 1), 6), e: ROUND(POW(x, 0.25), 6), f: ROUND(SIN(x), 6), g: ROUND(ATAN2(x, 2), 6), h: SIGN(c.c_acctbal), i: TRUNC(c.c_acctbal), j: CLAMP(c.c_acctbal, 0, 1000), l: ROUND(EXP(-x / 10000), 6), m: ROUND(DEGREES(x / 1000), 6), n: ROUND(LOG10(x + 1), 6), o: MOD(FLOOR(x), 7)}""", """
    SELECT c_custkey AS k, floor(b) AS a, ceil(b) AS b, round(sqrt(x), 6) AS c, round(ln(x + 1), 6) AS d, round(pow(x, 0.25), 6) AS e, round(sin(x), 6) AS f, round(atan2(x, 2), 6) AS g, CAST(sign(b) AS DOUBLE) AS h, trunc(b) AS i, least(greatest(b, 0.0), 1000.0) AS j,
      round(exp(-x / 10000), 6) AS l, round(degrees(x / 1000), 6) AS m, round(log10(x + 1), 6) AS n, floor(x) % 7 AS o FROM (SELECT c_custkey, c_acctbal AS b, abs(c_acctbal) AS x FROM customer)""")  # fmt: skip
add("functions_array", """
    FOR c IN customer LET a = [c.c_custkey % 7, c.c_custkey % 3, c.c_custkey % 5] RETURN {k: c.c_custkey, f: FIRST(a), l: LAST(a), n: NTH(a, 1), s: JOIN(SORTED(a), ","), r: JOIN(REVERSE(a), ","), sl: LENGTH(SLICE(a, 1)), p: POSITION(a, 2), su: SUM(a), av: ROUND(AVG(a), 6), mi: MIN(a), ma: MAX(a), md: MEDIAN(a), va: ROUND(VARIANCE(a), 6),
      mp: SUM(a |> MAP(x -> x * x)), fi: LENGTH(FILTER(a, x -> x > 2)), an: a |> ANY(x -> x == 4), al: a |> ALL(x -> x < 6), re: a |> REDUCE((acc, x) -> acc + x, 10), pu: LENGTH(PUSH(a, 9)), ch: LENGTH(CHUNK(a, 2)), rg: SUM(RANGE(1, 4)), fl: LENGTH(FLATTEN([a, a])), fd: a |> FIND(x -> x > 3)}""", """
    SELECT k, a[1] AS f, a[3] AS l, a[2] AS n, array_to_string([CAST(x AS BIGINT) FOR x IN list_sort(a)], ',') AS s, array_to_string([CAST(x AS BIGINT) FOR x IN list_reverse(a)], ',') AS r, CAST(2 AS BIGINT) AS sl, CAST(coalesce(list_position(a, 2.0), 0) - 1 AS BIGINT) AS p, list_sum(a) AS su, round(list_avg(a), 6) AS av, list_min(a) AS mi, list_max(a) AS ma, list_median(a) AS md, round(list_var_pop(a), 6) AS va,
      list_sum([x * x FOR x IN a]) AS mp, len([x FOR x IN a IF x > 2]) AS fi, list_contains(a, 4.0) AS an, list_max(a) < 6 AS al, list_sum(a) + 10 AS re, CAST(4 AS BIGINT) AS pu, CAST(2 AS BIGINT) AS ch, CAST(10 AS DOUBLE) AS rg, CAST(6 AS BIGINT) AS fl, [x FOR x IN a IF x > 3][1] AS fd
    FROM (SELECT c_custkey AS k, [CAST(c_custkey % 7 AS DOUBLE), CAST(c_custkey % 3 AS DOUBLE), CAST(c_custkey % 5 AS DOUBLE)] AS a FROM customer)""")  # fmt: skip
add("functions_object", 'FOR e IN events LET p = JSON_PARSE(e.props, "k bigint") LET o = MERGE({id: e.event_id, v: 1}, {v: 2, k: p.k}) RETURN {id: o.id, v: o.v, k: p.k, has: HAS(o, "k"), n: LENGTH(ATTRIBUTES(o)), keep: LENGTH(KEEP(o, "id", "k")), t: TO_NUMBER(JSON_PARSE(e.props)["k"])}', """
    SELECT event_id AS id, CAST(2 AS BIGINT) AS v, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS has, CAST(3 AS BIGINT) AS n, CAST(2 AS BIGINT) AS keep, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), 0.0) AS t FROM events""")  # fmt: skip
add("functions_type", 'FOR c IN customer RETURN {k: c.c_custkey, a: TYPEOF(c.c_name), b: TYPEOF(c.c_acctbal), c: IS_NUMBER(c.c_name), d: IS_STRING(c.c_name), e: TO_NUMBER(RIGHT(c.c_name, 3)), f: TO_BOOL(c.c_name), g: COALESCE(null, c.c_mktsegment), h: NULLIF(c.c_mktsegment, "BUILDING"), i: IF(c.c_acctbal > 0, "pos", "neg"), j: IS_NULL(c.nothing), l: TO_STRING(c.c_nationkey), m: IS_INTEGER(c.c_acctbal)}', """
    SELECT c_custkey AS k, 'string' AS a, 'int' AS b, false AS c, true AS d, CAST(right(c_name, 3) AS DOUBLE) AS e, true AS f, c_mktsegment AS g, nullif(c_mktsegment, 'BUILDING') AS h, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS i, true AS j, CAST(c_nationkey AS VARCHAR) AS l, c_acctbal = floor(c_acctbal) AS m FROM customer""")  # fmt: skip
add("functions_crypto", "FOR c IN customer RETURN {k: c.c_custkey, m: MD5(c.c_name), s: SHA256(c.c_name), b: BASE64_ENCODE(c.c_name), d: BASE64_DECODE(BASE64_ENCODE(c.c_name)), h: HEX_ENCODE(c.c_name)}", """
    SELECT c_custkey AS k, md5(c_name) AS m, sha256(c_name) AS s, base64(encode(c_name)) AS b, c_name AS d, lower(hex(encode(c_name))) AS h FROM customer""")  # fmt: skip
add("functions_geo", "FOR c IN customer LET p = {lat: c.c_custkey % 90, lon: c.c_nationkey * 7} RETURN {k: c.c_custkey, d: ROUND(GEO_DISTANCE(p, [48.85, 2.35]), 1), w: GEO_WITHIN(p, [[0, 0], [0, 45], [60, 45], [60, 0]])}", """
    SELECT c_custkey AS k, round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(48.85 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.85)) * pow(sin(radians(2.35 - lon) / 2), 2)))), 1) AS d, lon < 60 AND lat < 45 AS w
    FROM (SELECT c_custkey, CAST(c_custkey % 90 AS DOUBLE) AS lat, c_nationkey * 7.0 AS lon FROM customer)""")  # fmt: skip

# -- vectors and text

COSINE = "list_sum([z[1] * z[2] FOR z IN list_zip(e.v, q.v)]) / (sqrt(list_sum([x * x FOR x IN e.v])) * sqrt(list_sum([x * x FOR x IN q.v])))"
add("vector_top_k", "FOR q IN embeddings FILTER q.vec_id == 0 FOR e IN embeddings LET s = VECTOR_SIMILARITY(e.embedding, q.embedding) SORT s DESC, e.vec_id LIMIT 10 RETURN {id: e.vec_id, s: ROUND(s, 5), d: ROUND(VECTOR_DISTANCE(e.embedding, q.embedding), 5)}", f"""
    WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings) SELECT e.vec_id AS id, round({COSINE}, 5) AS s, round(sqrt(list_sum([pow(z[1] - z[2], 2) FOR z IN list_zip(e.v, q.v)])), 5) AS d
    FROM v e, v q WHERE q.vec_id = 0 ORDER BY {COSINE} DESC, e.vec_id LIMIT 10""")  # fmt: skip


@added("vector_search_api", f"""
    WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings) SELECT e.vec_id, round({COSINE}, 5) AS score FROM v e, v q WHERE q.vec_id = 1 ORDER BY {COSINE} DESC, e.vec_id LIMIT 20""")  # fmt: skip
def vector_search_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir).catalog.table("embeddings")
    query = df.where("vec_id = 1").select("embedding").first().embedding
    return search.vector_search(df, "embedding", query, 20, "cosine", "vec_id").select("vec_id", F.round("score", 5).alias("score"))


@added("fulltext_search", r"""
    WITH w AS (SELECT item_id, [x FOR x IN string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')), ' ') IF x <> ''] AS words FROM benchmark), q AS (SELECT ['the', 'and', 'thing'] AS terms)
    SELECT item_id, CAST(list_sum([CASE WHEN x = 'the' THEN 10 WHEN levenshtein(x, 'the') <= 2 THEN 5 ELSE 0 END + CASE WHEN x = 'and' THEN 10 WHEN levenshtein(x, 'and') <= 2 THEN 5 ELSE 0 END + CASE WHEN x = 'thing' THEN 10 WHEN levenshtein(x, 'thing') <= 2 THEN 5 ELSE 0 END FOR x IN words]) AS DOUBLE) AS score
    FROM w, q WHERE list_has_any(words, terms) ORDER BY score DESC""")  # fmt: skip
def fulltext_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.fulltext(engine(spark, sf_dir).catalog.table("benchmark"), "text", "the and thing", limit=None)
    return found.select("doc.item_id", "score")


# -- graph


def geography(spark: SparkSession, sf_dir: str) -> Engine:
    """Regions, nations and customers as vertices; edges from the smaller place to the larger one."""
    e = engine(spark, sf_dir)
    c = e.catalog
    vertices = lambda table, key, name, prefix: c.table(table).select(F.concat(F.lit(prefix), F.col(key)).alias("_key"), F.col(name).alias("name"))
    places = vertices("region", "r_regionkey", "r_name", "r").unionByName(vertices("nation", "n_nationkey", "n_name", "n")).unionByName(vertices("customer", "c_custkey", "c_name", "c"))
    at = lambda prefix, key: F.concat(F.lit(f"places/{prefix}"), F.col(key))
    up = c.table("nation").select(at("n", "n_nationkey").alias("_from"), at("r", "n_regionkey").alias("_to"))
    up = up.unionByName(c.table("customer").select(at("c", "c_custkey").alias("_from"), at("n", "c_nationkey").alias("_to")))
    c.add("places", places)
    c.add("within", up, kind="edge")
    return e


@added("graph_traverse", """
    SELECT c_name AS name, 'places/n' || n_nationkey AS via FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
    UNION ALL SELECT n_name, 'places/r1' FROM nation WHERE n_regionkey = 1""")  # fmt: skip
def graph_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geography(spark, sf_dir).query('FOR v, e IN 1..2 INBOUND "places/r1" within RETURN {name: v.name, via: e._to}')


@added("graph_traverse_each", "SELECT c_name AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'")
def graph_traverse_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geography(spark, sf_dir).query('FOR c IN customer FILTER c.c_mktsegment == "BUILDING" FOR v IN 2..2 OUTBOUND CONCAT("places/c", c.c_custkey) within RETURN {c: c.c_name, r: v.name}')


@added("graph_shortest_path", """
    SELECT 'places/c1' AS id UNION ALL SELECT 'places/n' || c_nationkey FROM customer WHERE c_custkey = 1
    UNION ALL SELECT 'places/r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1""")  # fmt: skip
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = geography(spark, sf_dir)
    region = e.query("FOR c IN customer FILTER c.c_custkey == 1 FOR n IN nation FILTER n.n_nationkey == c.c_nationkey RETURN n.n_regionkey").first()[0]
    return e.query('FOR v IN SHORTEST_PATH "places/c1" TO @to OUTBOUND within RETURN {id: v._id}', {"to": f"places/r{region}"})


# -- columnar, SQL, writing, streams


@added("columnar_group", """
    SELECT event_type, date_trunc('day', ts) AS ts, round(sum(value), 2) AS _agg FROM events WHERE value > 5 AND event_type <> 'error' GROUP BY ALL""")  # fmt: skip
def columnar_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Columnar(engine(spark, sf_dir).catalog, "events")
    where = {"and": [{"column": "value", "op": "gt", "value": 5}, {"column": "event_type", "op": "ne", "value": "error"}]}
    out = c.group_by(["event_type", {"column": "ts", "bucket": "1d"}], "value", "SUM", where)
    return out.select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("_agg", 2).alias("_agg"))


@added("columnar_aggregate", "SELECT count(DISTINCT user_id) AS _agg FROM events WHERE event_type IN ('click', 'view') OR value <= 1")
def columnar_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Columnar(engine(spark, sf_dir).catalog, "events")
    return c.aggregate("user_id", "COUNT_DISTINCT", {"or": [{"column": "event_type", "op": "in", "value": ["click", "view"]}, {"column": "value", "op": "lte", "value": 1}]})


SQL_TEXT = """
    SELECT n_name, count(*) AS c, round(avg(c_acctbal), 2) AS b FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal BETWEEN 0 AND 5000
    WHERE n_name LIKE 'N%' AND n_regionkey IS NOT NULL GROUP BY n_name HAVING count(*) > 1"""


@added("sql_select", SQL_TEXT)
def sql_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(SQL_TEXT)


@added("mutations", """
    SELECT 'c' || c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS b, CASE WHEN c_mktsegment = 'BUILDING' THEN 'vip' END AS t FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT 'new', 1.0, NULL""")  # fmt: skip
def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, writable=True)
    e.query('FOR c IN customer INSERT {_key: CONCAT("c", c.c_custkey), b: c.c_acctbal, s: c.c_mktsegment} INTO people')
    e.query('FOR p IN people FILTER p.b < 0 REMOVE p IN people')
    e.query('FOR p IN people FILTER p.s == "BUILDING" UPDATE p WITH {b: p.b + 100, t: "vip"} IN people')
    e.query('UPSERT {_key: "new"} INSERT {_key: "new", b: 1.0} UPDATE {b: 2.0} IN people')
    return e.query("FOR p IN people RETURN {k: p._key, b: p.b, t: p.t}")


@added("upsert_rows", """
    SELECT 'c' || c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'known' ELSE 'new' END AS s, CAST(CASE WHEN c_custkey % 2 = 0 THEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) ELSE c_nationkey END AS DOUBLE) AS n FROM customer
    UNION ALL SELECT NULL, r_name, 1.0 FROM region""")  # fmt: skip
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known customers are updated from a subquery, others inserted; rows that seek no key are inserted each."""
    e = engine(spark, sf_dir, writable=True)
    e.query('FOR c IN customer FILTER c.c_custkey % 2 == 0 INSERT {_key: CONCAT("c", c.c_custkey), s: "old", n: 0.0} INTO people')
    e.query('FOR c IN customer UPSERT {_key: CONCAT("c", c.c_custkey)} INSERT {_key: CONCAT("c", c.c_custkey), s: "new", n: c.c_nationkey * 1.0} UPDATE {s: "known", n: LENGTH((FOR o IN orders FILTER o.o_custkey == c.c_custkey RETURN o)) * 1.0} IN people')
    e.query('FOR r IN region LET none = r.r_regionkey < 0 ? "x" : null UPSERT none INSERT {_key: none, s: r.r_name, n: 1.0} UPDATE {s: "never"} IN people')
    return e.query('FOR p IN people RETURN {k: p._key =~ "^c[0-9]+$" ? p._key : null, s: p.s, n: p.n}')


def keyed(e: Engine, table: str, key: str, name: str | None = None) -> None:
    """A table of the driver's with its key as _key."""
    df = e.catalog.table(table)
    e.catalog.add(name or f"{table}_docs", df.withColumn("_key", F.col(key).cast("string")))


@added("document_by_ref", """
    SELECT s_suppkey AS k, n_name AS n, r_name AS r, [n_name] AS both FROM supplier
    LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")  # fmt: skip
def document_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by ids that rows hold: one id, a collection and a key, and an array of ids of which one isn't there."""
    e = engine(spark, sf_dir)
    keyed(e, "nation", "n_nationkey")
    keyed(e, "region", "r_regionkey")
    return e.query("""
        FOR s IN supplier LET ref = $"nation_docs/${s.s_nationkey}" LET n = DOCUMENT(ref) LET r = DOCUMENT("region_docs", TO_STRING(n.n_regionkey))
        RETURN {k: s.s_suppkey, n: n.n_name, r: r.r_name, both: DOCUMENT(["nation_docs/none", ref])[*].n_name}""")


@added("document_constant", "SELECT (SELECT n_name FROM nation WHERE n_nationkey = 3) AS a, (SELECT list(r_name ORDER BY r_regionkey) FROM region WHERE r_regionkey IN (1, 2)) AS b, true AS c")
def document_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    keyed(e, "nation", "n_nationkey")
    keyed(e, "region", "r_regionkey")
    return e.query('RETURN {a: DOCUMENT("nation_docs/3").n_name, b: SORTED(DOCUMENT(["region_docs/2", "region_docs/1", "region_docs/77"])[*].r_name), c: DOCUMENT("nation_docs", "none") == null}')


@added("sql_update_literals", """
    SELECT CAST(c_custkey AS BIGINT) AS k, CASE WHEN c_acctbal < 0 THEN 'no WHERE, here' ELSE c_mktsegment END AS s,
           CASE WHEN c_acctbal < 0 THEN (SELECT max(c_acctbal) FROM customer WHERE c_acctbal < 1000) ELSE c_acctbal END AS b FROM customer""")  # fmt: skip
def sql_update_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, writable=True)
    e.sql("INSERT INTO people (k, s, b) SELECT CAST(c_custkey AS BIGINT), c_mktsegment, c_acctbal FROM customer")
    e.sql("UPDATE people SET s = 'no WHERE, here', b = (SELECT max(c_acctbal) FROM customer WHERE c_acctbal < 1000) WHERE b < 0")
    return e.sql("SELECT k, s, b FROM people")


@added("sql_write", "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_regionkey = 2 THEN 'two' ELSE n_name END AS n FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT 100, 'added'")
def sql_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, writable=True)
    e.sql("INSERT INTO places (k, n, r) SELECT CAST(n_nationkey AS BIGINT), n_name, n_regionkey FROM nation")
    e.sql("DELETE FROM places WHERE r = 3")
    e.sql("UPDATE places SET n = 'two' WHERE r = :r", r=2)
    e.sql("INSERT INTO places (k, n, r) VALUES (100L, 'added', 9)")
    return e.sql("SELECT k, n FROM places")


@added("materialized_view", "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1")
def materialized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, writable=True)
    e.query("CREATE MATERIALIZED VIEW priorities AS FOR o IN orders COLLECT p = o.o_orderpriority WITH COUNT INTO n RETURN {p, n}")
    return e.query("REFRESH MATERIALIZED VIEW priorities")


def event_stream(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A windowed stream of the events by k and at. Each batch writes the windows that it changed, and state older than
    the watermark goes; of a window that several batches wrote, the last batch counts."""
    from ..lang.parser import parse

    e, folder = engine(spark, sf_dir), scratch(spark)
    path = f"{sf_dir}/events.parquet"
    e.streams["events"] = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    df, _ = streams.compiled(e, parse(text))
    keep = lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")  # noqa: E731  the same when it runs again
    df.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    last = rows.groupBy("k", "at").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("k", "at", "batch"))), "batch").alias("last"))
    return last.select("k", F.col("at").cast("timestamp_ntz").alias("at"), "last.*")


@added("stream_tumbling", "SELECT event_type AS k, date_trunc('hour', ts) AS at, count(*) AS n, round(sum(value), 2) AS s FROM events WHERE value > 10 GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one stream, until it is used up."""
    text = 'FOR e IN events FILTER e.value > 10 WINDOW TUMBLING (SIZE "1h") COLLECT k = e.event_type WITH COUNT INTO n AGGREGATE s = SUM(e.value) RETURN {k, at: window_start, n, s: ROUND(s, 2)}'
    return event_stream(spark, sf_dir, text)
