import tempfile
import uuid

from docmill.api import Engine
from docmill.sources.catalog import Catalog


def new_engine(spark, flat=False):
    return Engine(spark, Catalog(spark, f"file://{tempfile.mkdtemp()}/{uuid.uuid4().hex}"), flat)


def filled(spark, flat=False):
    """Small collections with nulls, missing matches, ties, a cycle and a dangling edge."""
    e = new_engine(spark, flat)
    add = lambda name, rows, ddl, kind="document": e.catalog.add(name, spark.createDataFrame(rows, ddl), kind)
    add("users", [("u1", "Ann", 30, "Oslo", True), ("u2", "Bob", None, "Rome", False), ("u3", "Cyd", 20, "Oslo", None), ("u4", None, 40, None, True)], "_key string, name string, age long, city string, active boolean")
    add("orders", [("o1", "u1", 10), ("o2", "u1", 20), ("o3", "u9", 5), ("o4", None, 7)], "_key string, user_key string, total long")
    add("sales", [("s1", "N", "2024-01-01", 10), ("s2", "N", "2024-01-02", 20), ("s3", "S", "2024-01-01", 5), ("s4", "S", "2024-01-03", 5), ("s5", "N", "2024-01-02", 20)], "_key string, region string, day string, amount long")
    add("people", [(k, k.title()) for k in ("alice", "bob", "carol", "diana", "eve")], "_key string, name string")
    edges = [("alice", "bob", 1), ("bob", "carol", 2), ("carol", "diana", 3), ("diana", "alice", 4), ("alice", "eve", 5), ("eve", "ghost", 6), ("bob", "bob", 7)]
    add("knows", [(f"people/{a}", f"people/{b}", n) for a, b, n in edges], "_from string, _to string, since long", "edge")
    add("nested", [("n1", ("Oslo", (59.9, 10.7)), ["a", "b"]), ("n2", None, []), ("n3", ("Rome", None), None)], "_key string, address struct<city:string,location:struct<lat:double,lng:double>>, tags array<string>")
    add("empty", [], "_key string, x long")
    add("articles", [("a1", "rust is a systems language", [1.0, 0.0, 0.0]), ("a2", "python for data science", [0.0, 1.0, 0.0]), ("a3", "web in rust and wasm", [0.8, 0.2, 0.0]), ("a4", None, None)], "_key string, content string, embedding array<float>")
    return e


def rows(e, text, **binds):
    """RETURN's values: plain where there is one column `value`, else tuples."""
    df = e.query(text, binds or None)
    return [r[0] if df.columns == ["value"] else tuple(r) for r in df.collect()]


def bag(values):
    return sorted(values, key=str)
