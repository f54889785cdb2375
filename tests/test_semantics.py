"""The language's rules, written once more in plain Python, against the engine."""

import itertools
import random

import pytest
from docmill.plans.compiler import Compiler, document

from .engine_helpers import bag, new_engine, rows

SAMPLES = [None, True, False, 0, 1, -1.5, 2.0, "", "a", "b", "1"]


def kind(x):
    return "null" if x is None else "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "text"


def equal(a, b):
    return kind(a) == kind(b) and a == b


def order(a, b):
    """-1, 0, 1: null first, kinds that differ are equal."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    return (a > b) - (a < b) if kind(a) == kind(b) else 0


def truthy(x):
    return x not in (None, False, 0, "")


RULES = {
    "==": equal,
    "!=": lambda a, b: not equal(a, b),
    "<": lambda a, b: order(a, b) < 0,
    "<=": lambda a, b: order(a, b) <= 0,
    ">": lambda a, b: order(a, b) > 0,
    ">=": lambda a, b: order(a, b) >= 0,
    "AND": lambda a, b: truthy(a) and truthy(b),
    "OR": lambda a, b: truthy(a) or truthy(b),
    "||": lambda a, b: a if truthy(a) else b,
    "??": lambda a, b: b if a is None else a,
}


def literal(x):
    return {None: "null", True: "true", False: "false"}[x] if x is None or isinstance(x, bool) else repr(x)


@pytest.mark.parametrize("op", list(RULES))
def test_operators_on_constants(spark, op):
    from docmill.lang.parser import parse_expression

    compiler = Compiler(spark, new_engine(spark).catalog)
    pairs = [(a, b) for a, b in itertools.product(SAMPLES, SAMPLES) if op not in ("||", "??") or kind(a) == kind(b)]
    made = [compiler.expr(parse_expression(f"{literal(a)} {op} {literal(b)}"), {}).col.alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    got = spark.range(1).select(*made).first()
    for (a, b), g in zip(pairs, got, strict=True):
        want = RULES[op](a, b)
        assert g == want or (g is None and want is None), (a, op, b, g)


TYPED = {"n": ("double", [None, -1.0, 0.0, 1.0]), "m": ("bigint", [None, 0, 1]), "s": ("string", [None, "", "a", "b"]), "f": ("boolean", [None, True, False])}


def test_operators_on_columns_as_values_and_in_filters(spark):
    """Every pair of columns and every column against a constant; FILTER keeps the rows for which the value is true."""
    data = list(itertools.product(*(v for _, v in TYPED.values())))
    df = spark.createDataFrame(data, ", ".join(f"{k} {t}" for k, (t, _) in TYPED.items()))
    e = new_engine(spark)
    e.catalog.add("t", df)
    frame = document(df, "x")
    compiler = Compiler(spark, e.catalog)
    from docmill.lang.parser import parse_expression

    names = list(TYPED)
    tests = [(f"x.{a}", op, f"x.{b}") for a, b in itertools.product(names, names) for op in ("==", "!=", "<", "<=", ">", ">=")]
    tests += [(f"x.{a}", op, literal(c)) for a in names for c in (None, 0, 1, "a", True) for op in ("==", "!=", "<", "<=", ">", ">=")]
    tests += [(literal(c), op, f"x.{a}") for a in names for c in (None, 0, "a") for op in ("==", "<", "<=", ">")]
    values = [compiler.expr(parse_expression(" ".join(p)), frame.scope).col for p in tests]
    filters = [compiler.expr(parse_expression(" ".join(p)), frame.scope, True, True).col for p in tests]
    look = lambda row, side: row[side[2:]] if side.startswith("x.") else eval(side, {"null": None, "true": True, "false": False})  # noqa: S307, E731
    for at in range(0, len(tests), 60):
        part = frame.df.select("x", *(c.alias(f"v{i}") for i, c in enumerate(values[at : at + 60])), *(c.alias(f"f{i}") for i, c in enumerate(filters[at : at + 60])))
        for row in part.collect():
            for i, (a, op, b) in enumerate(tests[at : at + 60]):
                want = RULES[op](look(row.x, a), look(row.x, b))
                assert row[f"v{i}"] is want, (row.x, a, op, b)
                assert (row[f"f{i}"] is True) is want, ("filter", row.x, a, op, b)


@pytest.mark.parametrize("seed", range(4))
def test_grouping_and_joins_of_random_documents(spark, seed):
    r = random.Random(seed)
    pick = lambda *xs: r.choice(xs)
    users = [{"_key": f"u{i}", "city": pick(None, "a", "b"), "age": pick(None, 1, 2, 3)} for i in range(r.randrange(0, 8))]
    orders = [{"_key": f"o{i}", "user": pick(None, *(f"u{k}" for k in range(6))), "total": pick(None, 5, 7)} for i in range(r.randrange(0, 12))]
    e = new_engine(spark)
    e.catalog.add("users", spark.createDataFrame([tuple(u.values()) for u in users], "_key string, city string, age long"))
    e.catalog.add("orders", spark.createDataFrame([tuple(o.values()) for o in orders], "_key string, user string, total long"))
    matches = lambda u: [o for o in orders if equal(o["user"], u["_key"])]
    total = lambda os: float(sum(o["total"] or 0 for o in os))

    groups = {}
    for u in users:
        groups.setdefault(u["city"], []).append(u)
    ages = lambda us: [u["age"] for u in us if u["age"] is not None]
    want = [(c, len(us), float(sum(ages(us))), sum(ages(us)) / len(ages(us)) if ages(us) else None, max(ages(us), default=None), len({u["age"] for u in us})) for c, us in groups.items()]
    assert bag(rows(e, "FOR u IN users COLLECT c = u.city WITH COUNT INTO n AGGREGATE s = SUM(u.age), a = AVG(u.age), m = MAX(u.age), d = COUNT_DISTINCT(u.age) RETURN {c, n, s, a, m, d}")) == bag(want)

    assert bag(rows(e, "FOR u IN users JOIN orders ON orders.user == u._key RETURN {k: u._key, n: LENGTH(orders), t: SUM(orders[*].total)}")) == bag((u["_key"], len(matches(u)), total(matches(u))) for u in users if matches(u))
    assert bag(rows(e, "FOR u IN users LEFT JOIN orders ON orders.user == u._key RETURN {k: u._key, o: SORTED(orders[*]._key)}")) == bag((u["_key"], sorted(o["_key"] for o in matches(u))) for u in users)
    left = {o["_key"]: next((u["_key"] for u in users if equal(u["_key"], o["user"])), None) for o in orders}
    assert bag(rows(e, "FOR u IN users RIGHT JOIN orders ON orders.user == u._key RETURN {o: orders._key, k: u._key}")) == bag(left.items())
    full = [(u["_key"], len(matches(u))) for u in users] + [(None, 1) for o in orders if left[o["_key"]] is None]
    assert bag(rows(e, "FOR u IN users FULL JOIN orders ON orders.user == u._key RETURN {k: u._key, n: LENGTH(orders)}")) == bag(full)
    theta = [(u["_key"], len([o for o in orders if order(o["total"], u["age"]) > 0])) for u in users]
    assert bag(rows(e, "FOR u IN users LEFT JOIN orders ON orders.total > u.age RETURN {k: u._key, n: LENGTH(orders)}")) == bag(theta)
    top = [(u["_key"], [o["total"] for o in sorted(matches(u), key=lambda o: (o["total"] is not None, o["total"] or 0), reverse=True)][:2]) for u in users]
    assert bag(rows(e, "FOR u IN users LET t = (FOR o IN orders FILTER o.user == u._key SORT o.total DESC LIMIT 2 RETURN o.total) RETURN {k: u._key, t}")) == bag(top)
    assert bag(rows(e, "FOR u IN users FILTER LENGTH((FOR o IN orders FILTER o.user == u._key AND o.total > 5 RETURN 1)) == 0 RETURN u._key")) == bag(u["_key"] for u in users if not any(order(o["total"], 5) > 0 for o in matches(u)))


@pytest.mark.parametrize("dealt", [lambda df: df.coalesce(1), lambda df: df.repartition(3, "_key")])
def test_ties_in_subqueries_follow_the_documents(spark, dealt):
    e = new_engine(spark)
    orders = [{"_key": f"o{i}", "user": f"u{i % 2}", "total": i // 4 % 2, "name": f"n{9 - i}"} for i in reversed(range(8))]
    e.catalog.add("users", spark.createDataFrame([("u0",), ("u1",)], "_key string"))
    e.catalog.add("orders", dealt(spark.createDataFrame([tuple(o.values()) for o in orders], "_key string, user string, total long, name string")))
    e.catalog.add("plain", e.catalog.table("orders").selectExpr("user", "total", "name", "map('a', _key) AS tags", "_key AS id"))

    def want(user, source, fall, low=0, high=None):
        key = {"orders": lambda o: o["_key"], "plain": lambda o: o["name"]}[source]
        mine = [o for o in sorted(orders, key=key) if user in (None, o["user"])]
        return [o["name"] for o in sorted(mine, key=lambda o: -o["total"] if fall else o["total"])][low:high]

    for source, (fall, word) in itertools.product(("orders", "plain"), enumerate(("", "DESC"))):
        top = f"(FOR o IN {source} FILTER o.user == u._key SORT o.total {word} LIMIT 1, 2 RETURN o.name)"
        assert bag(rows(e, f"FOR u IN users LET t = {top} RETURN [u._key, JOIN(t, ' ')]")) == [[u, " ".join(want(u, source, fall, 1, 3))] for u in ("u0", "u1")]
        assert bag(rows(e, f"FOR u IN users LET t = FIRST({top.replace('LIMIT 1, 2', '')}) RETURN [u._key, t]")) == [[u, want(u, source, fall)[0]] for u in ("u0", "u1")]
        assert rows(e, f"LET t = (FOR o IN {source} SORT o.total {word} LIMIT 5 RETURN o.name) RETURN JOIN(t, ' ')") == [" ".join(want(None, source, fall, 0, 5))]
    assert rows(e, "LET t = (FOR o IN plain SORT o.total LIMIT 1 RETURN o) RETURN LENGTH(t)") == [1]  # maps have no order
    assert rows(e, "FOR u IN users FILTER u._key == 'u0' LET a = ['z', u._key, 'a'] LET t = (FOR x IN a SORT LENGTH(x) RETURN x) RETURN JOIN(t, '')") == ["zau0"]


def test_top_per_row_does_not_hang_on_the_files(spark, tmp_path):
    from docmill.plans import catalog_queries

    customers, orders = spark.range(3).toDF("c_custkey"), spark.range(60).selectExpr("id AS o_orderkey", "id % 2 AS o_custkey", "double(id % 4 DIV 2) AS o_totalprice")
    got = []
    for name, order in (("up", "o_orderkey"), ("down", "-o_orderkey"), ("mixed", "o_orderkey * 17 % 60")):
        customers.write.parquet(f"{tmp_path}/{name}/customer.parquet")
        orders.coalesce(1).selectExpr("*", f"{order} AS at").sortWithinPartitions("at").drop("at").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        got.append(sorted(map(tuple, catalog_queries.QUERIES["subquery_top_per_row"](spark, f"{tmp_path}/{name}").collect())))
    assert got == [[(0, "2,6"), (1, "3,7"), (2, "")]] * 3


def test_top_per_row_gives_the_rows_of_its_sql_over_null_keys(spark, tmp_path):
    import duckdb
    from docmill.plans import catalog_queries

    customers = "VALUES (1), (2), (3), (NULL), (NULL)"
    orders = "VALUES (10, 1, 5.0), (NULL, 1, 4.0), (11, 1, 3.0), (NULL, 2, 9.0), (NULL, 2, 8.0), (12, 2, 7.0), (13, NULL, 6.0), (14, 3, NULL), (15, 3, 1.0)"
    db = duckdb.connect()
    for table, made in (("customer", f"FROM ({customers}) t(c_custkey)"), ("orders", f"FROM ({orders}) t(o_orderkey, o_custkey, o_totalprice)")):
        db.execute(f"CREATE TABLE {table} AS {made}")
        db.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    got = bag(map(tuple, catalog_queries.QUERIES["subquery_top_per_row"](spark, str(tmp_path)).collect()))
    assert got == bag(db.execute(catalog_queries.ORACLE_SQL["subquery_top_per_row"]).fetchall()) == bag([(1, "10"), (2, ""), (3, "15,14"), (None, ""), (None, "")])


def test_join_leaves_out_nulls(spark):
    e = new_engine(spark)
    assert rows(e, "RETURN [JOIN([1, null, 2], '-'), JOIN(['a', null, ''], '-'), JOIN([null], '-'), JOIN([null, 'b'])]") == [["1-2", "a-", "", "b"]]
