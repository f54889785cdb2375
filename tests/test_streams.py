import json

import pytest
from docmill.functions.values import QueryError
from docmill.sources import transfer
from docmill.streaming import streams

from .engine_helpers import filled, new_engine, rows

EVENTS = "type string, new struct<k:string,amount:double,at:timestamp>, old struct<k:string,amount:double,at:timestamp>"


@pytest.fixture
def e(spark, tmp_path):
    out = new_engine(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    made = lambda kind, k, amount, at: json.dumps({"type": kind, "new": {"k": k, "amount": amount, "at": at}})
    lines = [made("insert", "a", 150, "2024-01-01T00:00:10Z"), made("insert", "b", 50, "2024-01-01T00:00:20Z"), made("update", "a", 200, "2024-01-01T00:01:30Z"), made("delete", "a", 999, "2024-01-01T00:01:40Z"), made("insert", "c", 300, "2024-01-01T00:02:05Z")]
    (folder / "1.json").write_text("\n".join(lines))
    out.streams["events"] = transfer.change_feed(spark, f"file://{folder}", EVENTS)
    out.stream_options = streams.Options(trigger={"availableNow": True})
    return out


def run(e, text):
    q = e.query(text)
    q.awaitTermination()
    return [tuple(r) for r in e.spark.table(q.name).collect()]


def test_filter_stream(e):
    assert sorted(run(e, "CREATE STREAM large AS FOR e IN events FILTER e.amount > 100 RETURN {k: e.k, v: e.amount}")) == [("a", 150.0), ("a", 200.0), ("c", 300.0)]


def test_tumbling_window(e):
    got = run(e, 'CREATE STREAM minutes AS FOR e IN events WINDOW TUMBLING (SIZE "1m") COLLECT WITH COUNT INTO n AGGREGATE s = SUM(e.amount) RETURN {m: DATE_MINUTE(window_start), n, s}')
    assert sorted(got) == [(0, 2, 200.0), (1, 1, 200.0), (2, 1, 300.0)]


def test_sliding_window_and_keys(e):
    got = run(e, 'CREATE STREAM slide AS FOR e IN events FILTER e.k == "a" WINDOW SLIDING (SIZE "2m", SLIDE "1m") COLLECT k = e.k AGGREGATE s = SUM(e.amount) RETURN {k, s, m: DATE_MINUTE(window_start)}')
    assert sorted(got) == [("a", 150.0, 59), ("a", 200.0, 1), ("a", 350.0, 0)]


def test_rows_carry_their_window(e):
    got = run(e, 'CREATE STREAM plain AS FOR e IN events WINDOW TUMBLING (SIZE "1m") RETURN {k: e.k, m: DATE_MINUTE(window_start)}')
    assert sorted(got) == [("a", 0), ("a", 1), ("b", 0), ("c", 2)]


def test_results_in_files_resume(e, tmp_path):
    e.stream_options = streams.Options(trigger={"availableNow": True}, folder=f"file://{tmp_path}/out")
    text = "CREATE STREAM kept AS FOR e IN events FILTER e.amount > 100 RETURN {k: e.k}"
    for _ in range(2):
        e.query(text).awaitTermination()
    assert e.spark.read.parquet(f"{tmp_path}/out/kept/rows").count() == 3


def test_names_and_stop(e, tmp_path):
    e.stream_options = streams.Options()
    q = e.query("CREATE STREAM forever AS FOR e IN events RETURN e.k")
    assert "forever" in streams.running(e) and streams.stop(e, "forever") and not streams.stop(e, "forever")
    q.awaitTermination()


def test_live_queries_and_triggers(e, spark, tmp_path):
    e.catalog.add("users", filled(spark).catalog.table("users"))
    seen, acted = [], []
    now = {"availableNow": True}
    streams.live_query(e, "FOR u IN users COLLECT WITH COUNT INTO n RETURN n", e.streams["events"], lambda df: seen.append(df.first()[0]), f"file://{tmp_path}/s", now).awaitTermination()
    streams.on_change(e.streams["events"], lambda df, batch: acted.append(df.count()), ("delete",), f"file://{tmp_path}/s", now).awaitTermination()
    assert seen == [4] and acted == [1]


def test_a_stream_needs_a_streaming_source(e, spark):
    e.catalog.add("plain", spark.range(3).toDF("k"))
    with pytest.raises(QueryError):
        e.query("CREATE STREAM s AS FOR p IN plain RETURN p.k")
    with pytest.raises(QueryError):
        rows(e, 'FOR p IN plain WINDOW TUMBLING (SIZE "1m") RETURN p.k')
