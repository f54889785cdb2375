import pytest
from docmill.functions.values import QueryError
from docmill.lang.lexer import QuerySyntaxError
from docmill.lang.parser import parse

from .engine_helpers import bag, filled, new_engine, rows


@pytest.fixture(scope="module")
def e(spark):
    return filled(spark)


CASES = [
    # projection, binding
    ("RETURN 1 + 2", [3.0]),
    ("LET a = 1, b = a + 1 RETURN [a, b]", [[1.0, 2.0]]),
    ("FOR u IN users FILTER u._key == 'u1' RETURN u", [("u1", "Ann", 30, "Oslo", True)]),
    ("FOR n IN nested RETURN n.address?.location.lat", [59.9, None, None]),
    ("FOR n IN nested RETURN n['address'].city", ["Oslo", None, "Rome"]),
    ("FOR n IN nested RETURN n.tags[1]", ["b", None, None]),
    ("FOR n IN nested RETURN n.no.such.field", [None] * 3),
    ("LET o = {a: [{b: 1}, {b: 2}]} RETURN o.a[*].b", [[1, 2]]),
    ("RETURN [[1], [2, 3]][*]", [[1, 2, 3]]),
    ("LET k = 'x' LET o = {x: 5} RETURN o[k]", [5]),
    ('LET n = null RETURN $"a ${1.0} ${n} ${[1, 2]} b"', ["a 1 null [1,2] b"]),
    ("RETURN 0 ? 'y' : 'n'", ["n"]),
    ("FOR n IN nested RETURN n.tags ?? []", [["a", "b"], [], []]),
    ("LET a = [1] RETURN [1 ? a : [], 0 ? a : [null], UNION([], a)]", [[[1], [None], [1]]]),
    ("RETURN CASE null WHEN null THEN 1 ELSE 2 END", [1]),
    ("RETURN [1, 2, 3] |> MAP(x -> x * 2) |> FILTER(x -> x > 2) |> REDUCE((a, x) -> a + x, 0)", [10.0]),
    ("RETURN 1..4", [[1, 2, 3, 4]]),
    ("RETURN 3..1", [[]]),
    ("FOR i IN 2..3 FOR x IN [i, 0] RETURN x", [2, 0, 3, 0]),
    ("LET xs = [1, 2] FOR x IN xs RETURN x", [1, 2]),
    ("FOR u IN users FILTER u.age > 25 && u.active RETURN u._key", ["u1", "u4"]),
    # two-valued logic
    ("RETURN [null == null, null != 1, 1 == 1.0, '1' == 1]", [[True, True, True, False]]),
    ("RETURN [null < 0, 0 > null, null <= null, null < null, 1 >= null, false < true]", [[True, True, True, False, True, True]]),
    ("RETURN ['a' < 1, 'a' <= 1, 'a' > 1, 'a' >= 1]", [[False, True, False, True]]),
    ("FOR u IN users FILTER u.age < 25 RETURN u._key", ["u2", "u3"]),
    ("FOR u IN users FILTER 25 > u.age RETURN u._key", ["u2", "u3"]),
    ("FOR u IN users FILTER NOT (u.age < 25) RETURN u._key", ["u1", "u4"]),
    ("FOR u IN users FILTER u.age RETURN u._key", []),
    ("FOR u IN users FILTER u.age == null RETURN u._key", ["u2"]),
    ("FOR u IN users FILTER u.missing != 1 RETURN u._key", ["u1", "u2", "u3", "u4"]),
    ("FOR u IN users FILTER 10 / (u.age - 30) > 0 RETURN u._key", ["u4"]),
    ("RETURN [NOT 0, NOT '', NOT [], 1 AND 'x', 0 OR null]", [[True, True, True, True, False]]),
    ("RETURN [null ?? 1, 0 || 2, 5 || 2]", [[1, 2, 5]]),
    ("RETURN [7 % -3, -7 % 3, 7 & 3, 4 | 1, 5 ^ 1, 1 << 3, 8 >> 1, ~5, -(3)]", [[1.0, -1.0, 3.0, 5.0, 4.0, 8.0, 4.0, -6.0, -3.0]]),
    ("RETURN 'a' + 'b'", ["ab"]),
    ("RETURN [2 IN [1, 2], null IN [1, null], 'a' IN {a: 1}, 1 IN 5, 1 NOT IN 5]", [[True, True, True, False, True]]),
    ("RETURN ['abc' LIKE 'a%', 'abc' LIKE '_b_', 'ABC' LIKE 'a%', null LIKE '', 'a' NOT LIKE 'b']", [[True, True, False, True, True]]),
    ("RETURN ['abc' =~ 'b', 'abc' !~ 'b', 'abc' =~ '(', 'abc' !~ '(', 'hello' ~= 'hallo']", [[True, False, False, False, True]]),
    ("LET t = ['a', 'bb'] RETURN [ANY x IN t SATISFIES LENGTH(x) > 1, ALL x IN t SATISFIES LENGTH(x) > 1, NONE x IN t SATISFIES x == 'c']", [[True, False, True]]),
    # sort and limit
    ("FOR u IN users SORT u.age RETURN u._key", ["u2", "u3", "u1", "u4"]),
    ("FOR u IN users SORT u.age DESC RETURN u._key", ["u4", "u1", "u3", "u2"]),
    ("FOR u IN users SORT u._key LIMIT 1, 2 RETURN u._key", ["u2", "u3"]),
    # grouping
    ("FOR u IN users COLLECT c = u.city WITH COUNT INTO n SORT c RETURN [c, n]", [[None, "1"], ["Oslo", "2"], ["Rome", "1"]]),
    ("FOR u IN users COLLECT c = u.city RETURN c", [None, "Oslo", "Rome"]),
    ("FOR u IN users COLLECT WITH COUNT INTO n RETURN n", [4]),
    ("FOR x IN empty COLLECT WITH COUNT INTO n RETURN n", []),
    ("FOR x IN empty COLLECT AGGREGATE s = SUM(x.x) RETURN s", []),
    ("FOR u IN users COLLECT AGGREGATE c = COUNT(u.age), s = SUM(u.age), a = AVG(u.age), lo = MIN(u.age), hi = MAX(u.name), d = COUNT_DISTINCT(u.age), l = LENGTH(u.city), n = COUNT() RETURN {c, s, a, lo, hi, d, l, n}", [(3, 90.0, 30.0, 20, "Cyd", 4, 3, 4)]),
    ("FOR u IN users FILTER u.name == 'Bob' COLLECT AGGREGATE s = SUM(u.age), t = SUM(u.name), a = AVG(u.age) RETURN {s, t, a}", [(0.0, 0.0, None)]),
    ("FOR u IN users COLLECT AGGREGATE l = COLLECT_LIST(u.age) RETURN LENGTH(l)", [4]),
    ("FOR s IN sales COLLECT r = s.region INTO g SORT r RETURN {r, n: LENGTH(g), t: SUM(g[*].s.amount)}", [("N", 3, 50.0), ("S", 2, 10.0)]),
    ("FOR s IN sales COLLECT r = s.region INTO g SORT r RETURN {r, k: SORTED(g[*].s._key)}", [("N", ["s1", "s2", "s5"]), ("S", ["s3", "s4"])]),
    ("FOR s IN sales COLLECT r = s.region AGGREGATE t = SUM(s.amount) FILTER t > 20 RETURN r", ["N"]),
    # joins
    ("FOR u IN users JOIN orders ON orders.user_key == u._key RETURN {k: u._key, o: SORTED(orders[*].total)}", [("u1", [10, 20])]),
    ("FOR u IN users LEFT JOIN orders ON orders.user_key == u._key RETURN {k: u._key, n: LENGTH(orders), t: SUM(orders[*].total), m: MAX(orders[*].total)}", [("u1", 2, 30.0, 20.0), ("u2", 0, 0.0, None), ("u3", 0, 0.0, None), ("u4", 0, 0.0, None)]),
    ("FOR u IN users RIGHT JOIN orders ON orders.user_key == u._key RETURN {n: u.name, o: orders._key}", [("Ann", "o1"), ("Ann", "o2"), (None, "o3"), (None, "o4")]),
    ("FOR u IN users FULL OUTER JOIN orders ON orders.user_key == u._key RETURN {n: u._key, o: SORTED(orders[*]._key)}", [("u1", ["o1", "o2"]), ("u2", []), ("u3", []), ("u4", []), (None, ["o3"]), (None, ["o4"])]),
    ("FOR u IN users JOIN orders ON orders.total > u.age RETURN {k: u._key, o: SORTED(orders[*]._key)}", [("u2", ["o1", "o2", "o3", "o4"])]),
    ("FOR u IN users LEFT JOIN orders ON orders.user_key == u._key AND orders.total > 10 RETURN {k: u._key, o: orders[*].total}", [("u1", [20]), ("u2", []), ("u3", []), ("u4", [])]),
    ("FOR u IN users FOR o IN orders FILTER o.user_key == u._key AND o.total > 10 RETURN [u.name, o._key]", [["Ann", "o2"]]),
    # subqueries
    ("FOR u IN users FILTER LENGTH((FOR o IN orders FILTER o.user_key == u._key RETURN 1)) > 0 RETURN u._key", ["u1"]),
    ("FOR u IN users FILTER LENGTH((FOR o IN orders FILTER o.user_key == u._key RETURN 1)) == 0 RETURN u._key", ["u2", "u3", "u4"]),
    ("FOR u IN users FILTER u._key IN (FOR o IN orders RETURN o.user_key) RETURN u._key", ["u1"]),
    ("FOR u IN users LET t = (FOR o IN orders FILTER o.user_key == u._key SORT o.total DESC RETURN o.total) RETURN {k: u._key, t, f: FIRST(t)}", [("u1", [20, 10], 20), ("u2", [], None), ("u3", [], None), ("u4", [], None)]),
    ("FOR u IN users LET t = (FOR o IN orders FILTER o.user_key == u._key SORT o.total DESC LIMIT 1 RETURN o.total) RETURN t", [[20], [], [], []]),
    ("FOR u IN users RETURN SUM((FOR o IN orders FILTER o.user_key == u._key RETURN o.total))", [30.0, 0.0, 0.0, 0.0]),
    ("FOR u IN users LET c = (FOR o IN orders FILTER o.user_key == u._key COLLECT WITH COUNT INTO n RETURN n) RETURN FIRST(c)", [2, None, None, None]),
    ("FOR u IN users LET o = (FOR v IN users FILTER v.age > u.age RETURN v._key) RETURN {k: u._key, n: LENGTH(o)}", [("u1", 1), ("u2", 3), ("u3", 2), ("u4", 0)]),
    ("FOR n IN nested LET t = (FOR x IN n.tags FILTER x != 'a' RETURN UPPER(x)) RETURN t", [["B"], [], None]),
    ("LET all = (FOR o IN orders SORT o.total LIMIT 2 RETURN o.total) RETURN all", [[5, 7]]),
    ("FOR u IN users LET m = MAX((FOR o IN orders RETURN o.total)) FILTER u._key == 'u1' RETURN m", [20]),
    # windows
    ("FOR s IN sales RETURN {k: s._key, n: ROW_NUMBER() OVER (PARTITION BY s.region ORDER BY s.day, s._key), r: RANK() OVER (ORDER BY s.amount DESC), d: DENSE_RANK() OVER (ORDER BY s.amount DESC)}", [("s1", 1, 3, 2), ("s2", 2, 1, 1), ("s3", 1, 4, 3), ("s4", 2, 4, 3), ("s5", 3, 1, 1)]),
    ("FOR s IN sales RETURN {k: s._key, t: SUM(s.amount) OVER (PARTITION BY s.region ORDER BY s.day), l: LAST_VALUE(s._key) OVER (PARTITION BY s.region ORDER BY s._key), g: LAG(s.amount, 1, -1) OVER (PARTITION BY s.region ORDER BY s._key), e: LEAD(s.amount) OVER (PARTITION BY s.region ORDER BY s._key)}", None),
    ("FOR s IN sales SORT s._key LIMIT 2 RETURN COUNT(s.amount) OVER (ORDER BY s._key)", [1, 2]),
    # lookups
    ("RETURN DOCUMENT('users/u1').name", ["Ann"]),
    ("RETURN DOCUMENT('users', 'nobody') == null", [True]),
    ("FOR o IN orders LET u = DOCUMENT('users', o.user_key) RETURN u.name", ["Ann", "Ann", None, None]),
    ("RETURN COLLECTION_COUNT('orders')", [4]),
    ("RETURN LENGTH(SAMPLE('orders', 3))", [3]),
    ("FOR u IN users FILTER u.age >= @low RETURN u._key", ["u1", "u4"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_query(e, text, want):
    got = rows(e, text, **({"low": 30} if "@low" in text else {}))
    if want is not None:
        ordered = "SORT" in text.rpartition(")")[2] or " SORT u" in text
        assert (got if ordered else bag(got)) == (want if ordered else bag(want))
    assert got is not None


def test_running_windows_use_rows(e):
    got = {r[0]: r[1:] for r in rows(e, CASES[[c[0] for c in CASES].index(next(c[0] for c in CASES if "LAST_VALUE" in c[0]))][0])}
    assert got["s1"] == (10.0, "s5", -1, 20) and got["s3"] == (5.0, "s4", -1, 5) and got["s5"][1:] == ("s5", 20, None)
    assert sorted(got[k][0] for k in ("s2", "s5")) == [30.0, 50.0]


def test_flat_joins_multiply(spark):
    e = filled(spark, flat=True)
    assert bag(rows(e, "FOR u IN users LEFT JOIN orders ON orders.user_key == u._key RETURN [u._key, orders._key]")) == bag([["u1", "o1"], ["u1", "o2"], ["u2", None], ["u3", None], ["u4", None]])


@pytest.mark.parametrize("text", ["FOR u IN users", "RETURN", "FOR u users RETURN u", "RETURN 1 +", "RETURN {a:}", "RETURN [1", "LET x RETURN 1", "RETURN 'open", "RETURN 1 2"])
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


@pytest.mark.parametrize("text", ["RETURN nobody", "FOR x IN nowhere RETURN x", "RETURN NO_SUCH(1)", "RETURN @x", "RETURN 1 + 'a'", "RETURN UPPER(1)", "RETURN [1][-1]", "RETURN UPPER()"])
def test_meaning_errors(e, text):
    with pytest.raises(QueryError):
        e.query(text).collect()


@pytest.mark.parametrize("text", ["RETURN 1 / 0", "RETURN 1 % 0", "RETURN SQRT(-1)", "RETURN ASSERT(false, 'no')"])
def test_run_time_errors(e, text):
    with pytest.raises(Exception, match="(?i)zero|not defined|no"):
        e.query(text).collect()


def test_comments_quotes_and_case(spark):
    e = new_engine(spark)
    assert rows(e, "-- note\nlet `a b` = 'it''s' return `a b` -- end".replace("''", "\\'")) == ["it's"]
    assert rows(e, 'RETURN "\\u00e9\\n"') == ["é\n"]


def test_conditions_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "id % 5 AS g", "id AS unused").write.parquet(f"{tmp_path}/t")
    e = new_engine(spark)
    e.catalog.add_path("t", f"{tmp_path}/t")
    plan = e.explain("FOR x IN t FILTER x.g == 3 AND x.k < 50 RETURN x.k")
    assert "EqualTo(g,3)" in plan and "LessThan(k,50)" in plan and "unused" not in plan.split("ReadSchema")[1].split("\n")[0]
    e.catalog.add_path("s", f"{tmp_path}/t")
    joined = e.explain("FOR x IN t FOR y IN s FILTER x.k == y.k RETURN y.g")
    assert "Join" in joined and "NestedLoop" not in joined and "Cartesian" not in joined


@pytest.mark.parametrize(
    ("text", "shuffles"),
    [
        ("FOR u IN users JOIN orders ON orders.user_key == u._key RETURN {k: u._key, t: SUM(orders[*].total)}", 2),
        ("FOR u IN users LET a = SUM((FOR o IN orders FILTER o.user_key == u._key RETURN o.total)) LET b = LENGTH((FOR o IN orders FILTER o.user_key == u._key AND o.total > 5 RETURN 1)) RETURN {a, b}", 3),
        ("FOR u IN users LET t = (FOR o IN orders FILTER o.user_key == u._key SORT o.total LIMIT 2 RETURN o._key) RETURN {k: u._key, t}", 2),
        ("FOR s IN sales RETURN {a: SUM(s.amount) OVER (PARTITION BY s.region ORDER BY s.day), b: LAG(s.amount) OVER (PARTITION BY s.region ORDER BY s.day), c: RANK() OVER (PARTITION BY s.region ORDER BY s.amount)}", 1),
        ("FOR s IN sales COLLECT r = s.region INTO g RETURN {r, t: SUM(g[*].s.amount)}", 1),
    ],
)
def test_shuffles_are_shared(e, text, shuffles):
    conf = e.spark.conf
    before = {k: conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        conf.set("spark.sql.adaptive.enabled", "false")
        plan = e.query(text)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == shuffles and "Cartesian" not in plan and "NestedLoop" not in plan
