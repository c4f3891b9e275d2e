"""Golden cases of the operators, batch against stream, sinks and jobs."""

import json
import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import expressions as ex
from millrace.operators import external, reduce, relational, windows
from millrace.operators.relational import Aggregate
from millrace.plans import jobspec, nexmark
from millrace.plans.sql import SqlContext, SqlError, statements
from millrace.plans.stream import Elastic, Stream, check_job
from millrace.session import Env
from millrace.sources import kafka
from millrace.sources import nexmark as generator
from millrace.sources.snapshot_table import SnapshotTable, TwoPhaseSink, write_stream
from millrace.streaming import runs, state
from millrace.streaming.watermarks import Inputs, bounded, punctuated
from millrace.streaming.scaling import Autoscaler, Policy, TaskMetrics, of_progress


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order or df.columns).collect())


@pytest.fixture
def batch(spark):
    return spark.createDataFrame([(1, 10.0, True), (2, 20.0, False), (3, 30.0, True), (None, 40.0, False), (5, None, True)], "id long, value double, flag boolean")


def test_expressions(batch):
    got = batch.select(ex.build(batch, {"op": "add", "args": [{"col": 0}, {"lit": 1}]}).alias("a"), ex.build(batch, {"op": "and", "args": [{"op": "gt", "args": [{"col": 1}, {"lit": 15.0}]}, {"col": 2}]}).alias("b"), ex.build(batch, {"op": "div", "args": [{"col": 0}, {"lit": 2}]}).alias("c"))
    assert [tuple(r) for r in got.collect()] == [(2, False, 0), (3, False, 1), (4, True, 1), (None, False, None), (6, None, 2)]
    with pytest.raises(IndexError):
        ex.col_at(batch, 3)
    with pytest.raises(ValueError):
        ex.build(batch, {"op": "pow", "args": []})


def test_division(spark):
    got = spark.range(1).select(ex.div_double(F.lit(1.0), F.lit(0.0)), ex.div_double(F.lit(1.0), F.lit(-0.0)), ex.div_double(F.lit(-1.0), F.lit(0.0)), ex.div_double(F.lit(6.0), F.lit(4.0)), F.isnan(ex.div_double(F.lit(0.0), F.lit(0.0))), ex.div_long(F.lit(-7), F.lit(2))).first()
    assert tuple(got) == (float("inf"), float("-inf"), float("-inf"), 1.5, True, -3)


def test_filter_and_project(batch):
    assert relational.where(batch, F.col("value") > 15, F.col("flag")).count() == 1
    assert batch.where(ex.predicate(batch, None)).count() == 4
    assert batch.where(ex.predicate(batch, {"op": "gt", "col": 0, "val": 2})).count() == 2
    assert relational.project(batch, [1, (F.col("id") * 2, "twice", "bigint")]).columns == ["value", "twice"]
    with pytest.raises(TypeError):
        relational.project(batch, [(F.col("id") * 2, "twice", "double")])


def test_filter_project_100k(spark):
    df = spark.range(100_000).select("id", (F.col("id") * 1.5).alias("value"))
    got = relational.project(df.where("value > 75000"), [0, (F.col("value") * 2 + 1, "v")])
    assert got.count() == 49_999 and got.where("v <> 3 * id + 1").count() == 0


def test_hash_aggregate(spark):
    df = spark.createDataFrame([("eng", 100.0), ("sales", 200.0), ("eng", 150.0), ("sales", 50.0), ("eng", 200.0)], "department string, salary double")
    assert rows(relational.hash_aggregate(df, [0], [Aggregate("sum", 1, "s"), Aggregate("count", 1, "n"), Aggregate("avg", 1, "a")])) == [("eng", 450.0, 3.0, 150.0), ("sales", 250.0, 2.0, 125.0)]
    big = spark.range(10_000).select(F.concat(F.lit("dept_"), F.col("id") % 5).alias("d"), (F.col("id") * 10 + F.col("id") % 5 * 100).cast("double").alias("v"))
    for d, s, low, high in rows(relational.hash_aggregate(big, [0], [Aggregate("sum", 1, "s"), Aggregate("min", 1, "l"), Aggregate("max", 1, "h")])):
        own = [i * 10 + 100 * (i % 5) for i in range(int(d[-1]), 10_000, 5)]
        assert (s, low, high) == (sum(own), own[0], own[-1])
    assert relational.hash_aggregate(df.limit(0), [], [Aggregate("sum", 1, "s")]).count() == 0
    with pytest.raises(ValueError):
        Aggregate("median", 0, "m")
    with pytest.raises(ValueError):
        relational.grouped_sum(df, [], "salary", "s")


def test_joins(spark):
    build = spark.createDataFrame([(1, 100, 10.0), (2, 200, 20.0), (3, 100, 30.0), (4, 300, 40.0)], "order_id long, customer_id long, amount double")
    probe = spark.createDataFrame([(100, "Alice"), (200, "Bob"), (400, "Dave")], "customer_id long, name string")
    n = {how: relational.hash_join(build, probe, [1], [0], how) for how in relational.JOINS}
    assert {k: v.count() for k, v in n.items()} == {"inner": 3, "left": 4, "right": 4, "full": 5}
    assert n["right"].where("name = 'Dave'").first()["order_id"] is None
    assert n["inner"].columns == ["order_id", "customer_id", "amount", "probe_customer_id", "name"]
    assert relational.hash_join(build.limit(0), probe, [1], [0], "right").count() == 3
    nulls = spark.createDataFrame([(None, 1), (2, 2)], "k long, v long")
    assert relational.hash_join(nulls, nulls.select("*"), [0], [0]).count() == 1
    assert relational.hash_join(nulls, nulls.select("*"), [0], [0], null_safe=True).count() == 2
    for bad in ({"how": "cross"}, {"build_keys": []}):
        with pytest.raises(ValueError):
            relational.hash_join(**{"build": build, "probe": probe, "build_keys": [1], "probe_keys": [0], **bad})


def test_customers_and_orders(spark):
    c, o = spark.range(1000).toDF("customer_id"), spark.range(5000).select(F.col("id").alias("order_id"), (F.col("id") % 1000).alias("customer_id"), F.col("id").cast("double").alias("amount"))
    got = relational.hash_join(o, c, [1], [0])
    assert got.count() == 5000 and got.agg(F.sum("amount")).first()[0] == sum(range(5000))
    assert relational.hash_join(spark.range(1100).toDF("customer_id"), o, [0], [1], "left").count() == 5100


def test_window_aggregates(spark):
    df = spark.range(10_000).select((F.col("id") % 10).alias("u"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    got = rows(windows.window_aggregate(df, windows.Tumbling(1000), 1, [0], [Aggregate("sum", 2, "s"), Aggregate("count", 2, "n")]))
    assert len(got) == 100 and all(n == 100 and s == sum(range(a + u, b, 10)) for u, s, n, a, b in got)
    slid = rows(windows.window_aggregate(df.limit(5000), windows.Sliding(2000, 500), 1, [], [Aggregate("count", 2, "n")]), "window_start", "n")
    assert slid == [(s, min(5000, s + 2000) - max(0, s)) for s in range(-1500, 5000, 500)]
    one = spark.createDataFrame([("alice", 700, 1.0), ("bob", -1, None)], "u string, t long, v double")
    assert rows(windows.window_aggregate(one, windows.Sliding(1000, 500), 1, [0], [Aggregate("count", 2, "n"), Aggregate("min", 2, "m")])) == [("alice", 1, 1.0, 0, 1000), ("alice", 1, 1.0, 500, 1500), ("bob", 0, 0.0, -1000, 0), ("bob", 0, 0.0, -500, 500)]
    for bad in (lambda: windows.Tumbling(0), lambda: windows.Sliding(5, 0), lambda: windows.Session(-1)):
        with pytest.raises(ValueError):
            bad()


EVENT = "user string, ts long, value long"


def test_sessions(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 10, 2), ("a", 21, 3), ("b", 5, 4), ("a", 10, 5)], EVENT)
    n = F.sum("value").alias("s")
    assert rows(windows.aggregate(df, windows.Session(10), ["user"], "ts", n)) == [("a", 0, 20, 8), ("a", 21, 31, 3), ("b", 5, 15, 4)]
    assert rows(windows.aggregate(df, windows.Session(10, merge=False), ["user"], "ts", n)) == [("a", 0, 10, 1), ("a", 10, 20, 7), ("a", 21, 31, 3), ("b", 5, 15, 4)]
    assert rows(windows.aggregate(df, windows.Global(), ["user"], "ts", n), "user", "s") == [("a", 11), ("b", 4)]


@pytest.mark.parametrize(
    ("data", "delay", "assigner", "want"),
    [
        ([(1000, 1), (9000, 2), (8000, 3), (12000, 10), (5000, 1000)], 2000, windows.Tumbling(10_000), [(9999, 6), (19999, 10)]),
        ([(1, 1), (5, 5), (3, 3), (9, 9)], 3, windows.Tumbling(5), [(4, 4), (9, 14)]),
        ([(1000, 10), (5000, 20), (15000, 5)], 0, windows.Tumbling(10_000), [(9999, 30), (19999, 5)]),
        ([(7000, 1), (12000, 2)], 0, windows.Sliding(10_000, 5_000), [(9999, 1), (14999, 3), (19999, 2)]),
        ([(1000, 10), (5000, 20), (8000, 5), (9000, 15), (12000, 100), (3000, 9999)], 2000, windows.Tumbling(10_000), [(9999, 50), (19999, 100)]),
    ],
)
def test_late_rows(spark, data, delay, assigner, want):
    df = spark.createDataFrame([("u", t, v, k) for k, (t, v) in enumerate(data)], EVENT + ", arrival long")
    s = Stream(df).assign_timestamps_and_watermarks("ts", delay, ["arrival"]).key_by("user").window(assigner).reduce("value", "sum", "s")
    assert rows(s.df, "time", "s") == want


def test_on_time_matches_one_by_one(spark):
    rng = random.Random(4)
    data = [("u", max(0, i * 1000 + rng.randrange(-6000, 6000)), i, i) for i in range(2000)]
    want, top = [], None
    for r in data:
        if top is None or r[1] > top - 2500:
            want.append(r[3])
            top = r[1] if top is None else max(top, r[1])
    df = spark.createDataFrame(data, EVENT + ", arrival long")
    for bucket in (1, 7, 1 << 20, None):
        assert rows(windows.on_time(df, "ts", ["arrival"], 2500, bucket), "arrival") == [(k,) for k in want]


def test_reductions(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 5, 1), ("a", 2, 2), ("a", 3, 3)], "k string, v long, at long")
    assert rows(reduce.reduce_by(df, ["k"], "v", "sum")) == [("a", 6), ("b", 5)]
    assert rows(reduce.running(df, ["k"], "v", "sum", ["at"]), "at", "running") == [(0, 1), (1, 5), (2, 3), (3, 6)]
    assert rows(reduce.last_by(df, ["k"], "v", "at")) == [("a", 3), ("b", 5)]
    assert rows(reduce.fold(df, ["k"], F.col("v"), ["at"], lambda a, b: a * 10 - b, "f")) == [("a", (1 * 10 - 2) * 10 - 3), ("b", 5)]


def test_dsl(spark):
    env = Env(spark, "job")
    lines = env.from_iter([("hello world",), ("hello again",), ("world of streams",)], "line string")
    words = lines.flat_map(F.split("line", r"\s+"), "word").map("word", F.lit(1).alias("one")).key_by("word").reduce("one", "sum", "n")
    assert rows(words.df) == [("again", 1), ("hello", 2), ("of", 1), ("streams", 1), ("world", 2)]
    even = env.from_sequence(1, 100).filter(F.col("id") % 2 == 0).map((F.col("id") * F.col("id")).alias("sq")).map((F.col("sq") % 10).alias("digit"), "sq").key_by("digit").reduce("sq", "sum")
    got = rows(even.df)
    assert {k for k, _ in got} <= {0, 4, 6} and sum(v for _, v in got) == sum((2 * n) ** 2 for n in range(1, 51))
    assert rows(env.from_sequence(1, 10).map_rows(lambda r: [{"x": r["id"] ** 2}] if r["id"] > 5 else [], "x long").df) == [(n * n,) for n in range(6, 11)]
    with pytest.raises(ValueError):
        env.from_sequence(1, 2).key_by("id").window(windows.Tumbling(5)).reduce("id", "sum")
    env.from_sequence(1, 5).rebalance(3).discard()
    assert env.from_sequence(1, 5).broadcast().collect() == env.from_sequence(1, 5).broadcast(2).collect()


def test_job_checks():
    check_job(4, Elastic(), True, "two_phase_commit")
    for bad in ({"parallelism": 0}, {"elastic": Elastic()}, {"sink": "at_least_once"}, {"sink": "maybe"}, {"elastic": Elastic(5, 2), "tiered_state": True}):
        with pytest.raises(ValueError):
            check_job(**bad)


def test_sql(spark):
    c = SqlContext(spark, strict=True)
    data = [(i % 5, i) for i in range(100)]
    c.register_batches("t", [pa.RecordBatch.from_pylist([{"k": k, "v": v} for k, v in data[i : i + 17]]) for i in range(0, 100, 17)])
    assert c.sql("SELECT k, v FROM t WHERE v >= 95").count() == 5
    assert rows(c.sql("SELECT v * 2 AS doubled FROM t WHERE v < 3;")) == [(0,), (2,), (4,)]
    got = c.sql("SELECT x.k, SUM(x.v) AS s FROM t AS x WHERE x.v >= 50 GROUP BY x.k")
    assert rows(got) == [(k, float(sum(v for j, v in data if j == k and v >= 50))) for k in range(5)] and dict(got.dtypes)["s"] == "double"
    for bad in ("SELECT v FROM t ORDER BY v", "SELECT v FROM t LIMIT 1", "SELECT SUM(v) FROM t", "SELECT k, SUM(v), SUM(k) FROM t GROUP BY k", "SELECT k, COUNT(v) FROM t GROUP BY k", "SELECT a.v FROM t a JOIN t b ON a.k = b.k", "SELECT v FROM t UNION SELECT v FROM t", "SELECT 1; SELECT 2", ""):
        with pytest.raises(SqlError):
            c.sql(bad)
    with pytest.raises(SqlError):
        c.register_batches("e", [])
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        c.sql("SELECT v FROM missing")
    assert statements("select ';' -- a;b\n; select `;`") == ["select ';' \n".strip(), "select `;`"]
    assert SqlContext(spark).sql("SELECT max(v) AS m FROM t ORDER BY 1 LIMIT 1").first()["m"] == 99


def test_job_spec(spark):
    df = spark.range(1, 101)
    assert rows(jobspec.run(df, '{"type": "filter", "predicate": {"op": "gt", "col": 0, "val": 50}}')) == [(i,) for i in range(51, 101)]
    pairs = spark.range(1, 1001).select((F.col("id") % 10).alias("f0"), F.col("id").alias("f1"))
    got = jobspec.run_all(pairs, [{"type": "filter", "predicate": {"op": "gt", "col": 1, "val": 500}}, {"type": "hash_aggregate", "group_by_cols": [0], "aggregates": [{"function": "SUM", "input_col": 1, "output_name": "s"}]}])
    assert rows(got) == [(k, float(sum(i for i in range(501, 1001) if i % 10 == k))) for k in range(10)]
    assert jobspec.run(pairs, {"type": "hash_join", "join_type": "LEFT", "build_key_cols": [1], "probe_key_cols": [0]}, df).count() == 1000
    for bad in ({"type": "sort"}, {"type": "hash_join", "join_type": "semi", "build_key_cols": [0], "probe_key_cols": [0]}):
        with pytest.raises(ValueError):
            jobspec.run(df, bad, df)
    r = jobspec.Registry()
    r.register("double", lambda d, spec: d.select((F.col("id") * spec["by"]).alias("id")))
    assert r.build("double", df, {"by": 3}).agg(F.max("id")).first()[0] == 300
    assert r.build("builtin::filter", df, {"predicate": {"op": "lt", "col": 0, "val": 5}}).count() == 4
    with pytest.raises(KeyError):
        r.build("other", df, {})


def test_nexmark(spark):
    e = generator.events(spark, 5000, generator.Config(out_of_order_ms=10)).cache()
    assert {r["kind"]: r["count"] for r in e.groupBy("kind").count().collect()} == {"person": 100, "auction": 300, "bid": 4600}
    b, p, a = generator.bids(e), generator.persons(e), generator.auctions(e)
    assert b.where("price between 100 and 9999").count() == 4600 and a.where("initial_bid between 10 and 999 and category between 1 and 20 and expires > ts").count() == 300
    assert p.agg(F.count_distinct("id")).first()[0] == 100 and e.where("abs(ts - seq - 1) > 5").count() == 0
    assert b.where(F.col("auction") > F.floor(F.col("ts") / 50) * 3 + 4).count() == 0
    assert rows(e.limit(50).select("seq", "ts")) == rows(generator.events(spark, 50, generator.Config(out_of_order_ms=10)).select("seq", "ts"))
    assert nexmark.q1(b).count() == 4600 and nexmark.q2(b).count() == b.where("auction in (1,3,5,7,9)").count()
    bids = [(r.auction, r.ts) for r in b.collect()]
    first = min(t for _, t in bids) // 500 * 500
    want = {}
    for s in range(first, max(t for _, t in bids) + 1, 500):
        for x, t in bids:
            if s <= t < s + 1000:
                want[s + 1000, x] = want.get((s + 1000, x), 0) + 1
    assert rows(nexmark.q5(b, 1000, 500)) == sorted((w, x, n) for (w, x), n in want.items())
    pl, al = [(r.id, r.name, r.ts) for r in p.collect()], [(r.id, r.ts) for r in a.collect()]
    assert rows(nexmark.q8(p, a, 300)) == sorted((i, n, x) for i, n, t in pl for x, u in al if t // 300 == u // 300)


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}", "db", "t").create("k bigint, v bigint")
    sink, part = TwoPhaseSink(t), lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert t.scan().count() == 0
    for epoch, (a, b) in ((1, (0, 10)), (2, (10, 20))):
        sink.begin()
        sink.write(part(a, b))
        sink.pre_commit(epoch)
    assert t.scan().count() == 0 and sink.pending_epochs == [1, 2]
    assert sink.commit(1) == [1] and t.scan().count() == 10 and sink.commit(2) == [2] and t.scan().count() == 20
    assert t.scan(1).count() == 10 and t.snapshots() == [1, 2]
    sink.begin()
    sink.write(part(100, 105))
    sink.abort()
    with pytest.raises(RuntimeError):
        sink.write(part(0, 1))
    sink.begin()
    with pytest.raises(ValueError):
        sink.pre_commit(2)
    sink.write(part(5, 8))
    sink.pre_commit(7)
    assert sink.commit(9) == [7] and t.scan().count() == 23 and t.scan().where("k >= 100").count() == 0


def test_stream_to_snapshots(spark, tmp_path):
    schema = "user string, ts long, value long"
    df = spark.createDataFrame([("u", i, i) for i in range(30)], schema)
    assert runs.write_parts(df, ["ts"], [20, 10, 10], f"{tmp_path}/in") == 3
    with pytest.raises(ValueError):
        runs.write_parts(df, ["ts"], [31], f"{tmp_path}/bad")
    t = SnapshotTable(spark, f"file://{tmp_path}", "db", "t").create(schema)
    for _ in range(2):
        write_stream(runs.read_parts(spark, schema, f"{tmp_path}/in"), t, f"{tmp_path}/cp").awaitTermination()
    assert t.scan().agg(F.sum("value"), F.count("*")).first()[:] == (435, 30) and t.snapshots() == [1, 2, 3]
    t.publish(1, ["again"])  # an epoch that is in already
    assert t.snapshots() == [1, 2, 3]


def _stream(spark, tmp_path, data, positions):
    df = spark.createDataFrame([("u", t, v, k) for k, (t, v) in enumerate(data)], EVENT + ", arrival long")
    runs.write_parts(df, ["arrival"], positions, f"{tmp_path}/in")
    return runs.read_parts(spark, EVENT + ", arrival long", f"{tmp_path}/in")


def test_stateful_windows(spark, tmp_path):
    data = [(1000, 1), (9000, 2), (8000, 3), (12000, 10), (5000, 1000), (23000, 7)]
    plan = state.windowed(_stream(spark, tmp_path, data, [1, 2, 3, 4, 5]), ["user"], "ts", "value", windows.Tumbling(10_000), SUM, "long", 2000)
    out, ids, progress = runs.run_to_end(plan, f"{tmp_path}/cp")
    assert rows(out, "time", "result") == [(9999, 6), (19999, 10)] and ids == [0, 1, 2, 3, 4, 5]
    assert of_progress(progress[-1]).rows == 1
    assert rows(state.still_open(spark, f"{tmp_path}/cp", ["user"], SUM, "long"), "time", "result") == [(29999, 7)]


SUM = state.Folded(lambda a, b: a + b)


class Ends:
    """A user's own assigner: the window from a time to the next full thousand."""

    def of(self, time):
        return [(time - time % 1000, time - time % 1000 + 1000)]


class Eager(state.Trigger):
    """Fires and starts afresh at multiples of five; at the end of a window only what is left."""

    def on_element(self, count, time, start, end):
        return state.FIRE_AND_PURGE if time % 5 == 0 else state.CONTINUE


def test_user_assigner_trigger_and_watermark(spark, tmp_path):
    data = [(1, 1), (5, 2), (7, 4), (1001, 8), (2000, 16), (900, 32), (3100, 64)]
    plan = state.windowed(_stream(spark, tmp_path, data, [3]), ["user"], "ts", "value", Ends(), SUM, "long", trigger=Eager(), watermark=punctuated(lambda t: t % 1000 == 0))
    out = runs.run_to_end(plan, f"{tmp_path}/cp")[0]
    assert rows(out, "window_start", "result") == [(0, 3), (0, 4), (1000, 8), (2000, 16), (3000, 64)]  # 900 is behind the mark at 2000


def test_watermarks():
    w = Inputs(idle_ms=100)
    for name in "ab":
        w.register(name, 0)
    assert w.advance("a", 50, 10) is None and w.advance("b", 30, 20) == 30 and w.advance("b", 20, 30) is None and w.advance("b", 70, 40) == 50
    assert w.advance("b", 90, 150) == 90 and w.advance("a", 60, 160) is None and w.check(400) is None  # a was idle, and counts again
    assert w.advance("a", 95, 410) == 95 and w.end("a", 420) is None and w.advance("b", 97, 430) == 97
    assert bounded(5)(20, None) == 15 and punctuated(lambda t: t == 3)(4, 2) == 2
    with pytest.raises(ValueError):
        bounded(-1)


def test_trigger_that_fires_each_time(spark, tmp_path):
    plan = state.windowed(_stream(spark, tmp_path, [(1000, 10), (2000, 20), (3000, 5)], [2]), ["user"], "ts", "value", windows.Tumbling(10_000), SUM, "long", trigger=state.EachElement())
    assert sorted(r.result for r in runs.run_to_end(plan, f"{tmp_path}/cp")[0].collect()) == [10, 30, 35]  # without purge earlier rows count again
    (tmp_path / "b").mkdir()
    plan = state.windowed(_stream(spark, tmp_path / "b", [(1000, 10), (2000, 20)], [1]), ["user"], "ts", "value", windows.Tumbling(10_000), SUM, "long", trigger=state.Count(1))
    assert sorted(r.result for r in runs.run_to_end(plan, f"{tmp_path}/cp2")[0].collect()) == [10, 20]


def _everything(k, row, c):
    c.append("seen", row["value"])
    c.put("by", row["value"] % 2, row["value"])
    if row["value"] == 3:
        c.remove("by", 0)
    if row["value"] == 4:
        c.clear("seen")
    c.collect(k, len(c.items("seen")), c.lookup("by", 0) or -1)


def test_list_and_map_state(spark, tmp_path):
    plan = state.process(_stream(spark, tmp_path, [(t, t) for t in range(1, 6)], [2]), "user", state.Keyed(_everything, lists={"seen": "long"}, maps={"by": ("long", "long")}), "user string, n long, even long")
    assert rows(runs.run_to_end(plan, f"{tmp_path}/cp")[0], "n", "even") == sorted([(1, -1), (2, 2), (3, -1), (0, 4), (1, 4)])


def _remind(k, row, c):
    c.register_timer(row["ts"] + 1000)
    c.register_timer(row["ts"] + 1500)
    c.delete_timer(row["ts"] + 1500)


def _ring(k, at, c):
    c.collect(k, at)


def test_timers(spark, tmp_path):
    rows_ = _stream(spark, tmp_path, [(t, t) for t in (1000, 5000, 9000)], [1, 2]).withColumn("at_ts", F.timestamp_millis("ts")).withWatermark("at_ts", "0 seconds")
    plan = state.process(rows_, "user", state.Keyed(_remind, _ring), "user string, at long", "EventTime")
    assert {2000} <= {r.at for r in runs.run_to_end(plan, f"{tmp_path}/cp")[0].collect()} <= {2000, 6000}


def _count(row, old):
    n = int.from_bytes(old or b"\0", "big") + 1
    return [(row["user"], n)], n.to_bytes(8, "big")


def test_function_of_record_and_state(spark, tmp_path):
    plan = state.with_state(_stream(spark, tmp_path, [(t, t) for t in range(4)], [2]), "user", _count, "user string, n long")
    assert rows(runs.run_to_end(plan, f"{tmp_path}/cp")[0], "n") == [(1,), (2,), (3,), (4,)]
    state.verify_deterministic(_count, [({"user": "u"}, None)])
    with pytest.raises(ValueError):
        state.verify_deterministic(lambda r, s: ([random.random()], s), [({}, None)])


def _count_twice(row, old):
    n = int.from_bytes(old or b"\0", "big") + 2
    return [(row["user"], n)], n.to_bytes(8, "big")


def test_code_is_swapped_by_a_restart(spark, tmp_path):
    """Stop, then go on from the checkpoint with another function: state stays."""
    df = spark.createDataFrame([("u", t, t, t) for t in range(5)], EVENT + ", arrival long")
    got = []
    for k, function in enumerate((_count, _count_twice)):
        part = df.where(f"arrival % 2 = {k}")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        plan = state.with_state(runs.read_parts(spark, EVENT + ", arrival long", f"{tmp_path}/in"), "user", function, "user string, n long")
        got.append(rows(runs.run_to_end(plan, f"{tmp_path}/cp")[0], "n"))
    assert got == [[(1,), (2,), (3,)], [(1,), (2,), (3,), (5,), (7,)]]


def test_calls_have_a_deadline(spark):
    def slow(row):
        import time

        time.sleep(20 if row["id"] == 3 else 0)
        return [{"id": row["id"]}]

    import time

    start = time.monotonic()
    with pytest.raises(Exception, match="TimeoutError"):
        external.enrich(spark.range(8).coalesce(1), slow, "id long", timeout_s=0.5).collect()
    assert time.monotonic() - start < 15


def test_stream_equals_batch(spark, tmp_path):
    data = [(i * 700 % 20_000, i) for i in range(60)]
    s = Stream(_stream(spark, tmp_path, data, [20, 40])).assign_timestamps_and_watermarks("ts", 1000).key_by("user").window(windows.Tumbling(5000)).aggregate(F.sum("value").alias("s"))
    got, _, _ = runs.run_to_end(s.df, f"{tmp_path}/cp", "complete")
    df = spark.createDataFrame([("u", t, v) for t, v in data], EVENT)
    want = Stream(df).assign_timestamps_and_watermarks("ts", 1000).key_by("user").window(windows.Tumbling(5000)).aggregate(F.sum("value").alias("s"))
    assert rows(got) == rows(want.df, *got.columns)


def test_outside_calls(spark):
    tries = []

    def flaky(row):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return row["x"]

    waits = []
    assert external.call(flaky, {"x": 5}, sleep=waits.append) == 5 and waits == [0.1, 0.2]
    with pytest.raises(OSError):
        external.call(lambda r: (_ for _ in ()).throw(OSError()), {}, external.Retry(2), waits.append)
    assert external.Retry().delay(20) == 10.0
    assert external.enrich(spark.range(50), lambda r: [{"y": int(r["id"]) + 1}] * 2, "y long", concurrency=4).agg(F.sum("y")).first()[0] == 2550


def test_autoscaler():
    a, full, idle = Autoscaler(), [TaskMetrics(queue_usage=0.9)], [TaskMetrics(queue_usage=0.1)]
    p = Policy("backpressure", least=2, most=6)
    assert a.decide("x", p, 4, full, 0) == 6 and a.decide("x", p, 4, full, 30) is None and a.decide("x", p, 6, full, 100) is None
    assert a.decide("x", p, 5, idle, 100) == 2 and a.decide("y", p, 2, idle, 0) is None and a.decide("y", Policy(), 4, full, 0) is None
    t = Policy("throughput", target=100.0)
    assert a.decide("z", t, 4, [TaskMetrics(throughput=130.0)], 0) == 2 and a.decide("w", t, 4, [TaskMetrics(throughput=70.0)], 0) == 8 and a.decide("v", t, 4, [TaskMetrics(throughput=110.0)], 0) is None
    assert a.decide("u", p, 0, full, 0) is None and a.decide("u", p, 4, [], 0) is None


def test_kafka_model(spark):
    o = kafka.Offsets()
    o.mark("t", 1, 9)
    o.mark("t", 1, 4)
    o.mark("t", 0, 0)
    assert json.loads(o.snapshot()) == {"t": {"0": 1, "1": 10}} and kafka.Offsets.restore(o.snapshot()) == o
    assert kafka.source_options("h:1", "t", o, 5)["maxOffsetsPerTrigger"] == "5"
    with pytest.raises(ValueError):
        kafka.source_options("", "t")
    assert kafka.records(spark.range(1), F.col("id").cast("string"), F.lit("x"), F.lit(3)).columns == ["key", "value", "partition"]
    p = spark.range(7).toDF("partition")
    assert [rows(relational.assigned_partitions(p, 3, k)) for k in range(3)] == [[(0,), (3,), (6,)], [(1,), (4,)], [(2,), (5,)]]
    assert relational.split_by_hash(p, ["partition"], 4).where("part between 0 and 3").count() == 7
    with pytest.raises(ValueError):
        relational.assigned_partitions(p, 2, 2)


def test_division_by_zero_is_the_divisors(spark, tmp_path):
    """values of 0, below 0 and null divide by zero too."""
    from millrace.queries import QUERIES

    spark.createDataFrame([(0, 0.0), (3, -1.0), (6, None), (9, 2.0), (1, 0.0), (2, 5.0)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["exp_division"](spark, str(tmp_path))
    assert rows(got, "event_id", "kind") == [(0, "infinite"), (1, "finite"), (2, "finite"), (3, "infinite"), (6, "infinite"), (9, "infinite")]


def test_q8_deals_out_a_full_window(spark, monkeypatch):
    """one window's pairs are work for several tasks."""
    monkeypatch.setattr(nexmark, "BLOCK", 10, raising=False)
    p = spark.range(45).select("id", F.concat(F.lit("p"), "id").alias("name"), F.lit(5).cast("long").alias("ts"))
    a = spark.range(35).select("id", F.lit(7).cast("long").alias("ts")).union(spark.createDataFrame([(99, 1000)], "id long, ts long"))
    got = nexmark.q8(p, a, 100).withColumn("task", F.spark_partition_id()).cache()
    assert rows(got, "person_id", "person_name", "auction_id") == sorted((i, f"p{i}", x) for i in range(45) for x in range(35))
    assert got.select("task").distinct().count() > 1


def test_parts_have_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    """F12, F13, F15, F16: no task sorts or writes a whole part; a micro-batch takes all files of one."""
    monkeypatch.setattr(runs, "FILE_ROWS", 10, raising=False)
    df = spark.createDataFrame([("u", i * 7919 % 101, i) for i in range(101)], EVENT)
    assert runs.write_parts(df, ["ts"], [3, 60], f"{tmp_path}/in", "ts") == 4
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/in/*").select("ts", F.input_file_name().alias("f")).collect():
        got.setdefault(r.f.split("/")[-2], {}).setdefault(r.f, []).append(r.ts)
    assert [sorted(t for x in got[k].values() for t in x) for k in sorted(got)] == [list(range(3)), list(range(3, 60)), list(range(60, 101)), [runs.END_MS]]
    assert max(len(x) for part in got.values() for x in part.values()) <= 10 and len(got["000001"]) == 6
    stream = runs.read_parts(spark, EVENT, f"{tmp_path}/in")
    out, ids, progress = runs.run_to_end(stream, f"{tmp_path}/cp")
    assert ids == [0, 1, 2, 3] and [p["numInputRows"] for p in progress if p["numInputRows"]] == [3, 57, 41, 1] and out.count() == 102
    assert not (tmp_path / "in-sorted").exists()


class Store:
    """A store of state that counts its messages."""

    def __init__(self):
        self.calls, self.data, self.rings = 0, None, []

    def getValueState(self, *_):  # noqa: N802
        return self

    getListState = getMapState = getValueState  # noqa: N815

    def get(self):
        self.calls += 1
        return self.data

    def getValue(self, key):  # noqa: N802
        return self.get()

    def exists(self):
        return self.get() is not None

    containsKey = lambda self, key: self.exists()  # noqa: E731, N815
    iterator = lambda self: iter(self.get() or [])

    def update(self, x):
        self.calls, self.data = self.calls + 1, x

    def updateValue(self, key, x):  # noqa: N802
        self.calls, self.data = self.calls + 1, [(key, x)]

    def removeKey(self, key):  # noqa: N802
        self.calls, self.data = self.calls + 1, None

    def clear(self):
        self.update(None)

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.rings.append(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.rings.remove(ms)

    def getExpiryTimeInMs(self):  # noqa: N802
        return min(self.rings)

    getCurrentWatermarkInMs = lambda self: 10**9  # noqa: E731, N815


def test_messages_to_the_store_dont_grow_with_the_rows():
    """F2, F4, F9: a key's state is read once and written once in a micro-batch."""

    def step(k, row, c):
        c.set_value("n", (c.value("n") or 0) + row["value"])
        c.put("by", 1, (c.lookup("by", 1) or 0) + row["value"])
        c.collect(k, c.value("n"))

    keyed, store = state.Keyed(step, values={"n": "long"}, maps={"by": ("long", "long")}), Store()
    keyed.names = ["user", "n"]
    keyed.init(store)
    blocks = list(keyed.handleInputRows(("u",), iter([{"value": i} for i in range(5000)]), store))
    assert len(blocks) < 10 and store.calls <= 6


def test_timers_of_a_key_are_one_of_the_engine():
    """the engine knows the first timer of a key; all that have expired ring in order when it does."""
    keyed, store = state.Keyed(lambda k, row, c: c.register_timer(row["ts"]), _ring), Store()
    keyed.names, keyed.by_events = ["user", "at"], True
    keyed.init(store)
    list(keyed.handleInputRows(("u",), iter([{"ts": t} for t in (*range(500, 0, -1), 10**10)]), store))
    assert store.calls <= 4 and store.rings == [1]
    blocks = list(keyed.handleExpiredTimer(("u",), store, store))
    store.rings.remove(1)  # the engine deletes what has rung
    assert [r for b in blocks for r in pickle.loads(b["_rows"])] == [("u", t) for t in range(1, 501)] and store.rings == [10**10]


def test_large_state_is_written_between_rows(spark, tmp_path, monkeypatch):
    """What is held at once has a bound, and lists and maps stay whole over it."""

    def step(k, row, c):
        c.append("all", row["value"])
        c.put("by", row["value"] % 40, row["value"])
        if row["value"] == 149:
            c.collect(k, len(c.items("all")), sum(c.items("all")), len(c.entries("by")), sum(c.entries("by").values()))

    monkeypatch.setattr(state, "HELD", 16)
    plan = state.process(_stream(spark, tmp_path, [(t, t) for t in range(150)], [70]), "user", state.Keyed(step, lists={"all": "long"}, maps={"by": ("long", "long")}), "user string, n long, s long, keys long, last long", order=["arrival"])
    out = runs.run_to_end(plan, f"{tmp_path}/cp", ordered=True)[0]
    assert rows(out) == [("u", 150, sum(range(150)), 40, sum(range(110, 150)))]


def test_order_within_a_micro_batch(spark, tmp_path):
    """Several files, read by several tasks, give a key's rows in the order of arrival."""
    df = spark.createDataFrame([(f"u{i % 3}", i, i, i) for i in range(300)], EVENT + ", arrival long")
    for k in range(4):  # the files are read in another order
        df.where(f"arrival % 4 = {k}").orderBy(F.desc("arrival")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    plan = state.running_reduce(runs.read_parts(spark, EVENT + ", arrival long", f"{tmp_path}/in", 4), "user", "value", lambda a, b: a * 31 + b & 0xFFFFFFFF, "string", "long", ["arrival"])
    got, want, acc = rows(runs.run_to_end(plan, f"{tmp_path}/cp", ordered=True)[0]), [], {}
    for i in range(300):
        u = f"u{i % 3}"
        acc[u] = acc[u] * 31 + i & 0xFFFFFFFF if u in acc else i
        want.append((u, acc[u]))
    assert got == sorted(want)


def _described(key, start, end, frame):
    import pandas as pd

    return pd.DataFrame({"user": [key[0]], "start": [start], "n": [len(frame)], "kinds": [" ".join(f"{c}:{t}" for c, t in frame.dtypes.items()) + f" {list(frame.index)[:1]}"], "s": [None if frame["value"].isna().all() else float(frame["value"].sum())]})


def test_windows_share_arrow_batches(spark):
    """a batch has many windows, each with the types of its own rows."""
    from millrace.plans import stream

    df = spark.range(3000).select(F.when(F.col("id") % 300 != 7, F.concat(F.lit("u"), F.col("id") % 300)).alias("user"), (F.col("id") * 10).alias("ts"), F.when(F.col("id") % 11 != 0, F.col("id") + 2**53).alias("value"), F.when(F.col("id") % 13 != 0, F.col("id") % 2 == 0).alias("flag"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # windows span batches too
    try:
        got = Stream(df).assign_timestamps_and_watermarks("ts", 0).key_by("user").window(windows.Tumbling(9000)).apply(_described, "user string, start long, n long, kinds string, s double").df.collect()
        r = windows.Tumbling(9000).assign(df, "ts")
        want = r.groupBy("user", "window_start", "window_end").applyInPandas(lambda g, f: _described(g[:1], int(g[1]), int(g[2]), f.drop(columns=["window_start", "window_end"])), "user string, start long, n long, kinds string, s double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 900
    calls = []
    frames = spark.range(50).select("id", F.lit(1).alias("x")).coalesce(1)
    one = stream.by_group(frames, ["id"], lambda g, f: f, "id long, x int").mapInPandas(lambda it: [__import__("pandas").DataFrame({"n": [len(f)]}) for f in it], "n long")
    calls = [r.n for r in one.collect()]
    assert sum(calls) == 50 and len(calls) < 10
