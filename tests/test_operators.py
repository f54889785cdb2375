import pytest
from docmill.functions.values import QueryError
from docmill.operators import graph, mutations, search
from docmill.operators.columnar import Columnar
from docmill.sources import transfer

from .engine_helpers import bag, filled, new_engine, rows


@pytest.fixture
def e(spark):
    return filled(spark)


# -- writing


def test_insert_makes_keys_and_overwrites_known_ones(e):
    assert rows(e, "FOR i IN 1..3 INSERT {n: i} INTO nums RETURN NEW.n") != []
    table = e.catalog.table("nums")
    assert {"_key", "_id", "_rev", "_created_at", "_updated_at", "n"} <= set(table.columns) and table.select("_key").distinct().count() == 3
    e.query("INSERT {_key: 'u1', name: 'New'} INTO users")
    assert bag(rows(e, "FOR u IN users RETURN [u._key, u.name]")) == bag([["u1", "New"], ["u2", "Bob"], ["u3", "Cyd"], ["u4", None]])
    assert rows(e, "INSERT {_key: 'k', a: 1} INTO fresh") == [(1, 0, 0)]


def test_update_merges_and_binds_old_and_new(e):
    got = rows(e, "FOR u IN users FILTER u.city == 'Oslo' UPDATE u WITH {age: u.age + 1, tag: 'x', _key: 'no'} IN users SORT NEW._key RETURN [OLD.age, NEW.age]")
    assert got == [[30, 31], [20, 21]]
    assert bag(rows(e, "FOR u IN users RETURN [u._key, u.tag, u.name]")) == bag([["u1", "x", "Ann"], ["u2", None, "Bob"], ["u3", "x", "Cyd"], ["u4", None, None]])
    assert rows(e, "UPDATE 'u2' WITH {name: 'Rob'} IN users") == [(0, 1, 0)]
    assert rows(e, "UPDATE 'nobody' WITH {name: 'Rob'} IN users") == [(0, 0, 0)]
    assert rows(e, "FOR u IN users FILTER u.name == 'Rob' RETURN u._key") == ["u2"]


def test_remove(e):
    assert rows(e, "FOR u IN users FILTER u.age > 25 REMOVE u IN users RETURN OLD._key") in (["u1", "u4"], ["u4", "u1"])
    assert rows(e, "REMOVE 'u2' IN users") == [(0, 0, 1)]
    assert rows(e, "FOR u IN users RETURN u._key") == ["u3"]


def test_upsert_updates_replaces_and_inserts(e):
    e.query("UPSERT {_key: 'u1'} INSERT {_key: 'u1', name: 'no'} UPDATE {name: 'Anna'} IN users")
    e.query("UPSERT {_key: 'u9'} INSERT {_key: 'u9', name: 'Zed'} UPDATE {name: 'no'} IN users")
    e.query("UPSERT {_key: 'u2'} INSERT {_key: 'u2'} REPLACE {name: 'Only'} IN users")
    assert bag(rows(e, "FOR u IN users RETURN {k: u._key, n: u.name, c: u.city}")) == bag([("u1", "Anna", "Oslo"), ("u2", "Only", None), ("u3", "Cyd", "Oslo"), ("u4", None, None), ("u9", "Zed", None)])


def test_collections_have_kinds(e):
    with pytest.raises(QueryError):
        e.query("INSERT {_from: 'a/1', _to: ''} INTO knows")
    e.catalog.kinds["sales"] = "timeseries"
    with pytest.raises(QueryError):
        e.query("UPDATE 's1' WITH {amount: 1} IN sales")


def test_prune_expire_unique_truncate_vacuum(spark):
    e = new_engine(spark)
    c = e.catalog
    c.replace("log", spark.createDataFrame([("0000018c-0000-7000-8000-000000000000", 1_000), ("ffffffff-0000-7000-8000-000000000000", None)], "_key string, at long"))
    assert mutations.prune(c, "log", 0x018C00000001).count() == 1
    c.replace("ttl", spark.createDataFrame([(1, 1_000), (2, None), (3, 9_999_999_999_999)], "k long, at long"))
    assert [r.k for r in mutations.expire(c, "ttl", "at", 60).orderBy("k").collect()] == [2, 3]
    assert mutations.unique_violations(c.table("ttl").union(c.table("ttl")), "k").count() == 2
    assert c.truncate("ttl").count() == 0 and c.versions("ttl") == [1, 2, 3]
    c.vacuum("ttl")
    assert c.versions("ttl") == [3]


def test_validation_is_strict_or_lenient(spark):
    df = spark.createDataFrame([(1, "a"), (-1, None)], "n long, s string")
    rules = {"positive": "n > 0", "named": "s IS NOT NULL"}
    assert [r._violations for r in mutations.validate(df, rules, strict=False).orderBy("n").collect()] == [["positive", "named"], []]
    with pytest.raises(Exception, match="schema: positive, named"):
        mutations.validate(df, rules).collect()


def test_views_are_kept_and_refreshed(e):
    e.query("CREATE MATERIALIZED VIEW old AS FOR u IN users FILTER u.age > 25 RETURN {k: u._key}")
    e.query("INSERT {_key: 'u8', age: 80} INTO users")
    assert bag(rows(e, "FOR o IN old RETURN o.k")) == ["u1", "u4"]
    e.catalog.views.clear()  # the definition is read again from its table
    e.query("REFRESH MATERIALIZED VIEW old")
    assert bag(rows(e, "FOR o IN old RETURN o.k")) == ["u1", "u4", "u8"]
    with pytest.raises(QueryError):
        e.query("REFRESH MATERIALIZED VIEW none")


# -- graph


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("FOR v IN OUTBOUND 'people/alice' knows RETURN v.name", ["Bob", "Eve"]),
        ("FOR v IN 1..9 OUTBOUND 'people/alice' knows RETURN v.name", ["Bob", "Carol", "Diana", "Eve"]),
        ("FOR v, e IN 0..1 INBOUND 'people/alice' knows RETURN [v.name, TO_STRING(e.since)]", [["Alice", ""], ["Diana", "4"]]),
        ("FOR v IN 2..2 ANY 'people/alice' knows RETURN v.name", ["Carol"]),
        ("FOR v IN 1..2 OUTBOUND 'people/nobody' knows RETURN v.name", []),
        ("FOR p IN people FILTER p._key == 'bob' FOR v IN OUTBOUND CONCAT('people/', p._key) knows RETURN [p.name, v.name]", [["Bob", "Carol"]]),
        ("FOR v, e IN SHORTEST_PATH 'people/alice' TO 'people/diana' OUTBOUND knows RETURN [v.name, TO_STRING(e.since)]", [["Alice", ""], ["Bob", "1"], ["Carol", "2"], ["Diana", "3"]]),
        ("FOR v IN SHORTEST_PATH 'people/alice' TO 'people/diana' ANY knows RETURN v.name", ["Alice", "Diana"]),
        ("FOR v IN SHORTEST_PATH 'people/eve' TO 'people/alice' OUTBOUND knows RETURN v.name", []),
        ("FOR v IN SHORTEST_PATH 'people/eve' TO 'people/eve' OUTBOUND knows RETURN v.name", ["Eve"]),
    ],
)
def test_graph(e, text, want):
    got = rows(e, text)
    assert got == want if "SHORTEST" in text else bag(got) == bag(want)


def test_graph_api(e, spark):
    starts = spark.createDataFrame([("people/alice",), ("people/bob",)], "start string")
    assert bag((r.start, r.depth, r.vertex["name"]) for r in graph.traverse(e.catalog, starts, "knows").collect()) == bag([("people/alice", 1, "Bob"), ("people/alice", 1, "Eve"), ("people/bob", 1, "Carol")])
    assert graph.invalid_edges(spark.createDataFrame([("a", None), ("", "b"), ("a", "b")], "_from string, _to string")).count() == 2


# -- search


def test_search_functions_in_queries(e):
    assert rows(e, "FOR r IN FULLTEXT('articles', 'content', 'rust') SORT r.doc._key RETURN {k: r.doc._key, s: r.score, m: r.matched}") == [("a1", 10.0, ["rust"]), ("a3", 10.0, ["rust"])]
    assert rows(e, "FOR r IN FULLTEXT('articles', 'content', 'dats python') RETURN {k: r.doc._key, s: r.score}") == [("a2", 15.0)]
    assert rows(e, "FOR r IN VECTOR_SEARCH('articles', 'embedding', [1, 0, 0], 2) RETURN r.doc._key") == ["a1", "a3"]
    both = rows(e, "FOR r IN HYBRID_SEARCH('articles', 'embedding', 'content', [1.0, 0.0, 0.0], 'rust', {fusion: 'rrf', limit: 2}) RETURN {k: r.doc._key, s: r.sources}")
    assert both == [("a1", ["vector", "fulltext"]), ("a3", ["vector", "fulltext"])]
    assert rows(e, "FOR a IN articles SORT BM25(a.content, 'web') DESC LIMIT 1 RETURN a._key") == ["a3"]
    assert rows(e, "RETURN LENGTH(FULLTEXT('articles', 'content', 'rust'))") == [2]


def test_weighted_fusion_and_corpus_bm25(e):
    df = e.catalog.table("articles")
    got = search.hybrid_search(df, "_key", "embedding", [1.0, 0, 0], "content", "rust", 0.9, 0.1).collect()
    assert [r.doc["_key"] for r in got] == ["a1", "a3", "a2"] and got[0].score == pytest.approx(1.0) and got[2].text_score is None
    assert [r._key for r in search.bm25_search(df, "content", "web rust", "_key").collect()] == ["a3", "a1"]


def test_quantised_search_agrees_with_exact(spark):
    import random

    r = random.Random(1)
    df = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)], "k long, v array<double>")
    query = [r.gauss(0, 1) for _ in range(8)]
    coded, low, high = search.quantised(df, "v", 8)
    exact = [x.k for x in search.vector_search(df, "v", query, 5, "euclidean", "k").collect()]
    assert [x.k for x in search.quantised_search(coded, low, high, "v", query, 5, "euclidean").collect()] == exact


def test_places(spark):
    df = spark.createDataFrame([("paris", 48.8566, 2.3522), ("london", 51.5074, -0.1278), ("oslo", 59.91, 10.75), ("none", None, None)], "k string, lat double, lon double")
    assert [r.k for r in search.near(df, "lat", "lon", (48.9, 2.4), 2).collect()] == ["paris", "london"]
    assert [r.k for r in search.within_radius(df, "lat", "lon", (48.9, 2.4), 10_000).collect()] == ["paris"]


# -- columnar, SQL, transfer


def test_columnar(spark):
    e = new_engine(spark)
    c = Columnar(e.catalog, "t")
    at = [f"2024-01-01 {x}" for x in ("10:05:00", "10:45:00", "11:10:00", "11:50:00", "12:05:00")]
    c.insert(spark.createDataFrame([(a, float(i), "x" if i % 2 else "y") for i, a in enumerate(at)] + [(None, None, None)], "at string, v double, k string").selectExpr("cast(at AS timestamp) AS at", "v", "k"))
    hours = c.group_by([{"column": "at", "bucket": "1h"}], "v", "SUM", {"column": "v", "op": "gte", "value": 0}).orderBy("at").collect()
    assert [(r["at"].hour, r._agg) for r in hours] == [(10, 1.0), (11, 5.0), (12, 4.0)]
    value = lambda f, where=None: c.aggregate("v", f, where).first()._agg
    assert (value("COUNT"), value("COUNT_DISTINCT"), value("AVERAGE"), value("MAX"), value("SUM", {"or": [{"column": "k", "op": "eq", "value": "x"}, {"column": "v", "op": "lt", "value": 1}]})) == (6, 6, 2.0, 4.0, 4.0)
    assert c.delete({"and": [{"column": "k", "op": "in", "value": ["x"]}, {"column": "v", "op": "ne", "value": 3}]}).count() == 5
    assert c.read(["v"], {"column": "v", "op": "gt", "value": 2}, 1).columns == ["v"]
    with pytest.raises(QueryError):
        c.aggregate("v", "NOPE")


def test_sql(e):
    sql = lambda text, **args: [tuple(r) for r in e.sql(text, **args).collect()]
    assert sql("SELECT city, count(*) n FROM users WHERE age > :low OR age IS NULL GROUP BY city HAVING count(*) >= 1 ORDER BY n DESC, city LIMIT 2", low=25) == [(None, 1), ("Oslo", 1)]
    assert sql("SELECT u.name, o.total FROM users AS u LEFT JOIN orders o ON o.user_key = u._key WHERE u.name IN ('Ann', 'Bob') ORDER BY o.total") == [("Bob", None), ("Ann", 10), ("Ann", 20)]
    e.sql("INSERT INTO t (a, b) VALUES (1, 'x, y'), (2, 'z')")
    assert [tuple(r)[:2] for r in e.sql("UPDATE t SET b = concat(b, ', ', 'w'), a = a + 10 WHERE b LIKE 'x%'").select("a", "b").collect()] == [(11, "x, y, w")]
    assert e.sql("DELETE FROM t WHERE a = 2").count() == 1
    assert sql("SELECT a, b FROM t") == [(11, "x, y, w")]
    with pytest.raises(QueryError):
        e.sql("DROP TABLE t")


def test_import_and_export(e, tmp_path):
    transfer.export_jsonl(e.catalog, "knows", f"{tmp_path}/out")
    back = transfer.import_export(e.catalog, "knows2", f"{tmp_path}/out")
    assert back.count() == 7 and e.catalog.kinds["knows2"] == "edge"
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert transfer.import_json(e.spark, f"{tmp_path}/a.json", lines=False).count() == 2
    assert transfer.blobs(e.spark, f"{tmp_path}/a.json").select("length").first().length == 20


def test_pages_shards_and_vector_statistics(e, tmp_path):
    assert [len(p) for p in e.pages(e.query("FOR i IN 1..25 RETURN {i}"), 10)] == [10, 10, 5]
    for n in (1, 2):
        e.catalog.table("users").where(f"age >= {n * 15}").write.parquet(f"{tmp_path}/shard{n}")
    e.catalog.add_shards("sharded", [f"{tmp_path}/shard1", f"{tmp_path}/shard2"])
    assert bag(rows(e, "FOR s IN sharded RETURN s._key")) == ["u1", "u3", "u4"]
    assert rows(e, "LET s = VECTOR_INDEX_STATS('articles', 'embedding') RETURN [s.vectors, s.missing, s.dimension]") == [[3, 1, 3]]
    e.catalog.replace("b", e.catalog.table("users"), membership=("_key",))
    assert rows(e, "FOR b IN b FILTER b._key == 'u1' RETURN b.name") == ["Ann"]


def test_tables_are_read_while_they_are_replaced(e):
    e.catalog.replace("t", e.spark.range(5).toDF("k"))
    e.catalog.replace("t", e.catalog.table("t").where("k > 2"))
    assert e.catalog.table("t").count() == 2


def test_fulltext_query_has_no_limit(spark):
    from docmill.operators import search
    from docmill.plans import catalog_queries

    plan = catalog_queries.QUERIES["fulltext_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
    many = spark.range(150).selectExpr("id", "'some thing' AS text")
    assert search.fulltext(many, "text", "thing", limit=None).count() == 150 and search.fulltext(many, "text", "thing", limit=7).count() == 7


def test_upsert_follows_rows_of_a_key_and_keeps_rows_without_one(spark):
    e = filled(spark)
    e.catalog.add("src", spark.createDataFrame([(None, "u"), (None, "v"), ("u1", "w"), ("u1", "x"), ("n1", "y"), ("n1", "z")], "k string, n string"))
    e.catalog.replace("people2", e.catalog.table("users").select("_key", "name"))
    counts = e.query("FOR s IN src UPSERT s.k INSERT {_key: s.k, name: s.n} UPDATE {name: CONCAT(s.n, s.n)} IN people2").first()
    assert (counts.inserted, counts.updated) == (3, 3)
    got = bag(rows(e, "FOR p IN people2 RETURN {k: p._key IN ['u1', 'u2', 'u3', 'u4', 'n1'] ? p._key : 'made', n: p.name}"))
    assert got == bag([("u1", "xx"), ("u2", "Bob"), ("u3", "Cyd"), ("u4", None), ("n1", "zz"), ("made", "u"), ("made", "v")])


def test_upsert_with_subqueries(spark):
    e = filled(spark)
    e.catalog.replace("totals", spark.createDataFrame([("u1", 0.0)], "_key string, t double"))
    e.query("FOR u IN users UPSERT {_key: u._key} INSERT {_key: u._key, t: SUM((FOR o IN orders FILTER o.user_key == u._key RETURN o.total))} UPDATE {t: LENGTH((FOR o IN orders FILTER o.user_key == u._key RETURN o))} IN totals")
    assert bag(rows(e, "FOR t IN totals RETURN {k: t._key, t: t.t}")) == [("u1", 2.0), ("u2", 0.0), ("u3", 0.0), ("u4", 0.0)]


def test_documents_by_ids_of_rows(spark):
    e = filled(spark)
    assert bag(rows(e, "FOR k IN knows LET d = DOCUMENT(k._to) RETURN {s: k.since, n: d.name}")) == bag([(1, "Bob"), (2, "Carol"), (3, "Diana"), (4, "Alice"), (5, "Eve"), (6, None), (7, "Bob")])
    assert bag(rows(e, 'FOR o IN orders RETURN {k: o._key, n: DOCUMENT("users", o.user_key).name}')) == bag([("o1", "Ann"), ("o2", "Ann"), ("o3", None), ("o4", None)])
    got = rows(e, 'FOR k IN knows FILTER k.since == 6 LET d = DOCUMENT([k._from, k._to, "people/bob", k._from]) RETURN d[*].name')
    assert got == [["Eve", "Bob", "Eve"]]
    assert rows(e, 'FOR o IN orders FILTER o.total > 15 RETURN DOCUMENT("users", [o.user_key, "u3", "zz"])[*].name') == [["Ann", "Cyd"]]


def test_unique_indexes_hold_at_every_write(spark):
    e = filled(spark)
    e.catalog.replace("mails", spark.createDataFrame([("a", "x"), ("b", None)], "_key string, mail string"))
    e.catalog.unique["mails"] = [("mail",)]
    e.query('INSERT {_key: "c", mail: null} INTO mails')
    for text in ('INSERT {_key: "d", mail: "x"} INTO mails', 'UPDATE "b" WITH {mail: "x"} IN mails', 'UPSERT "q" INSERT {mail: "x"} UPDATE {mail: "y"} IN mails', "FOR i IN 1..2 INSERT {_key: TO_STRING(i), mail: 'twice'} INTO mails"):
        with pytest.raises(QueryError, match="unique"):
            e.query(text)
    e.query('UPDATE "a" WITH {mail: "x"} IN mails')
    assert bag(rows(e, "FOR m IN mails RETURN {k: m._key, m: m.mail}")) == [("a", "x"), ("b", None), ("c", None)]


def test_where_in_literals_and_subqueries_of_sql_updates(spark):
    e = filled(spark)
    e.catalog.replace("t", spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "_key string, n int, s string"))
    e.sql("UPDATE t SET s = 'no WHERE, here', n = (SELECT max(n) FROM t WHERE n < 9) WHERE _key = 'a'")
    e.sql("DELETE FROM t WHERE s = 'WHERE'")
    assert bag([tuple(r) for r in e.sql("SELECT _key, n, s FROM t").collect()]) == [("a", 2, "no WHERE, here"), ("b", 2, "y")]


def test_several_distinct_counts_of_all_rows_need_no_copies(spark):
    e = filled(spark)
    df = e.query("FOR s IN sales COLLECT AGGREGATE r = COUNT_DISTINCT(s.region), d = COUNT_DISTINCT(s.day), n = SUM(s.amount) RETURN {r, d, n}")
    assert [tuple(r) for r in df.collect()] == [(2, 3, 60.0)] and "Expand" not in df._jdf.queryExecution().toString()
    assert rows(e, "FOR s IN empty COLLECT AGGREGATE r = COUNT_DISTINCT(s.x), d = COUNT_DISTINCT(s._key) RETURN {r, d}") == []


def test_a_writer_gives_up_when_another_was_faster(e):
    e.catalog.replace("t", e.spark.range(3).toDF("k"))
    read = e.catalog.version("t")
    e.catalog.replace("t", e.spark.range(4).toDF("k"))
    with pytest.raises(QueryError, match="changed by another"):
        e.catalog.replace("t", e.spark.range(9).toDF("k"), after=read)
    assert e.catalog.table("t").count() == 4
    fs, claim = e.catalog._fs(f"{e.catalog.folder('t', 9)}/_claim")  # a writer that died
    fs.createNewFile(claim)
    e.catalog.replace("t", e.spark.range(5).toDF("k"))
    assert e.catalog.table("t").count() == 5 and e.catalog.versions("t")[-1] == 10


def test_columns_of_the_result_may_have_names_of_variables(e):
    got = rows(e, "FOR u IN users FILTER u._key == 'u1' LET a = [3, 1, 2] LET n = 1 RETURN {a: 7, n: a |> MAP(x -> x + n), m: SUM(a), k: VARIANCE(a)}")
    assert got == [(7, [4.0, 2.0, 3.0], 6.0, pytest.approx(2 / 3))]


def test_only_files_that_hold_a_changed_key_are_written_again(e):
    rows_ = e.spark.range(100).selectExpr("lpad(id, 3, '0') AS _key", "id AS n").repartitionByRange(5, "_key")
    e.catalog.replace("t", rows_)
    before = set(e.catalog.files("t"))
    e.query('FOR x IN t FILTER x._key == "007" UPDATE x WITH {n: -1} IN t')
    kept = set(e.catalog.files("t")) & before
    assert len(kept) == len(before) - 1 == 4
    e.query('REMOVE "099" IN t')
    assert len(set(e.catalog.files("t")) & before) == 3
    got = dict(rows(e, "FOR x IN t RETURN {k: x._key, n: x.n}"))
    assert got == {f"{i:03d}": i for i in range(99)} | {"007": -1}
    e.catalog.vacuum("t")
    assert dict(rows(e, "FOR x IN t RETURN {k: x._key, n: x.n}")) == got and len(e.catalog.versions("t")) == 1
    e.query('FOR x IN t FILTER x.n > 90 REMOVE x IN t')
    e.catalog.compact("t")
    e.catalog.vacuum("t")
    assert len(rows(e, "FOR x IN t RETURN x")) == 91 and all(f.startswith(f"v{e.catalog.version('t'):06d}/") for f in e.catalog.files("t"))
    e.query('FOR x IN t UPDATE x WITH {tag: "wide"} IN t')  # another column: the whole table is written
    assert set(rows(e, "FOR x IN t RETURN x.tag")) == {"wide"}


def test_vector_index_reads_few_lists(spark, tmp_path):
    import random

    r = random.Random(3)
    middles = [[r.gauss(0, 1) for _ in range(6)] for _ in range(20)]
    df = spark.createDataFrame([(i, [m + 0.1 * r.gauss(0, 1) for m in middles[i % 20]]) for i in range(800)] + [(900, None)], "k long, v array<double>")
    for metric in ("cosine", "euclidean"):
        index = search.VectorIndex.build(df, "v", f"file://{tmp_path}/{metric}", metric, lists=20)
        hit = 0
        for q in (df.where(f"k = {i}").first().v for i in range(5)):
            exact = [x.k for x in search.vector_search(df, "v", q, 10, metric, "k").collect()]
            found = index.search(q, 10, probes=3, order="k")
            hit += len(set(exact) & {x.k for x in found.collect()})
            assert [x.k for x in index.search(q, 10, probes=20, order="k").collect()] == exact
        assert hit >= 45 and "PartitionFilters: [" in found._jdf.queryExecution().toString()
