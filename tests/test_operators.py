from pyspark.sql import functions as F

from folioscope.operators import graph, inventory, matching, ordered, rules, sets, timeline
from folioscope.streaming import jobs


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_bands_join_at_equality(spark):
    df = spark.createDataFrame([(1, 0), (1, 274_320), (1, 548_641)], "k int, v long")
    assert rows(ordered.bands(df, ["k"], ["v"], F.col("v"), 274_320), "v", "band") == [(0, 1), (274_320, 1), (548_641, 2)]


def test_forward_owner_takes_the_mark_itself(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "a"), (1, 3, None), (1, 4, "b"), (1, 5, None)], "k int, o int, mark string")
    out = ordered.forward_owner(df, ["k"], ["o"], F.col("mark").isNotNull(), F.col("mark"), "owner")
    assert [x[1] for x in rows(out.fillna("-", ["owner"]), "o", "owner")] == ["a", "a", "b", "b", "-"]


def test_islands_and_spans(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, "b"), (1, 5, "a")], "k int, o int, v string")
    assert [x[1] for x in rows(ordered.islands(df, ["k"], ["o"], F.col("v")), "o", "island")] == [1, 1, 2, 3, 4]
    assert rows(ordered.running_spans(df, ["k"], ["o"], F.lit(2), 1), "o", "start", "end")[-1] == (5, 12, 14)


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, at int")
    right = spark.createDataFrame([(1, 5, "e"), (1, 4, "d"), (1, 2, "b")], "k int, at int, v string")
    assert sorted(ordered.as_of(left, right, ["k"], "at", ["v"]).collect(), key=str) == sorted([(1, 1, None), (1, 5, "e"), (2, 9, None)], key=str)
    assert ("d",) in [tuple(r) for r in ordered.as_of(left, right, ["k"], "at", ["v"], strict=True).select("as_of_v").collect()]


def test_positions_are_gapless(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("h"), "id")
    got = [r.position for r in ordered.positions(df, ["h"]).orderBy("h").collect()]
    assert got == list(range(500))


def test_cycles(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "C"), ("C", "B"), ("D", "D"), ("E", "A")], "a string, b string")
    assert [x[0] for x in rows(graph.cyclic_nodes(edges))] == ["A", "B", "C", "D"]


def test_batch_plan(spark):
    jobs_ = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "name string")
    targets = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "missing")], "name string, target string")
    assert rows(graph.batch_plan(jobs_, targets)) == [("a", "ready", 1, 0, True), ("b", "ready", 1, 1, True), ("c", "duplicate", 0, 0, False)]


def test_inheritance(spark):
    nodes = spark.createDataFrame([("r", None, "R", True), ("m", "r", None, False), ("l", "m", None, None), ("x", "y", None, None), ("y", "x", "Y", None), ("o", "gone", None, None)], "id string, parent string, font string, bold boolean")
    out = {r.id: (r.font, r.bold) for r in graph.inherited(nodes, ["font", "bold"]).collect()}
    assert out == {"r": ("R", True), "m": ("R", False), "l": ("R", False), "x": ("Y", None), "y": ("Y", None), "o": (None, None)}


def test_multisets(spark):
    a = spark.createDataFrame([(1, "lost lost word")], "k int, t string")
    b = spark.createDataFrame([(1, "lost")], "k int, t string")
    missing = inventory.missing_tokens(inventory.token_counts(a, ["k"], "t"), inventory.token_counts(b, ["k"], "t"), ["k"])
    assert rows(missing) == [(1, 2)]
    assert rows(sets.differences(spark.range(3), spark.range(1, 4))) == [(0, "left"), (3, "right")]


def test_notes_and_modes(spark):
    notes = spark.createDataFrame([("c", 1, "x", 0), ("c", 0, "y", 1), ("c", 1, "z", 2)], "code string, page int, status string, o int")
    assert [tuple(r) for r in inventory.note_summary(notes, ["code"], "page", "status", "o").collect()] == [("c", 3, [1, 2], "x")]
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (1, "a"), (1, "b")], "k int, v string")
    assert rows(inventory.first_mode(df, ["k"], "v", ["v"])) == [(1, "a", 2)]


def test_matching(spark):
    a = spark.createDataFrame([(1, 10.0, 1), (1, 10.0, 2), (1, 12.0, 3), (2, 0.0, 4)], "k int, v double, i int")
    assert rows(matching.binned_pairs(a, ["k"], "v", "i", 2.0), "a", "b", "gap") == [(1, 2, 0.0), (1, 3, 2.0), (2, 3, 2.0)]
    near = {r.i: r.near for r in matching.nearest(a, ["k"], "v", "i").collect()}
    assert near == {1: 2, 2: 1, 3: 1, 4: None}
    left = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "g int, o int")
    right = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6)], "g int, p int")
    assert rows(matching.zipped(left, right, ["g"], ["o"], ["p"]), "g", "o", "p") == [(1, 1, 5), (1, 2, 6), (2, 1, 5)]
    assert rows(matching.zipped(left, right, ["g"], ["o"], ["p"], True), "g", "o", "p") == [(1, 1, 5), (1, 2, 6)]


def test_rules(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, 500)], "i int, n int")
    own = [("small", "info", F.col("n") < 10), ("large", "error", F.col("n") > 100)]
    assert rows(rules.findings(df, ["i"], own)) == [(1, 0, "small", "info"), (3, 1, "large", "error")]
    tiers = df.withColumn("c", rules.codes(own)).select("i", rules.tier(F.col("c"), ["large"]).alias("t"))
    assert [x[1] for x in rows(tiers)] == ["converted_with_review", "converted", "manual_migration_required"]


def test_plan_problems(spark):
    requests = spark.createDataFrame(
        [(1, 1, "create", "shape_1", 0, 0, 0), (1, 2, "insert", "shape_1", 0, 0, 5), (1, 3, "style", "shape_1", 0, 6, 0), (1, 4, "insert", "shape_1", 9, 0, 1), (1, 5, "create", "shape_1", 0, 0, 0), (1, 6, "delete", "nothing", 0, 1, 0), (1, 7, "paint", "x", 0, 0, 0)],
        "page int, seq int, kind string, id string, start int, end int, length int",
    )
    assert rows(rules.plan_problems(requests)) == [(1, 3, "range_out_of_text"), (1, 4, "index_out_of_range"), (1, 5, "duplicate_id"), (1, 6, "missing_target"), (1, 6, "range_out_of_text"), (1, 7, "bad_id"), (1, 7, "unknown_kind")]


def test_timeline(spark):
    effects = spark.createDataFrame([(1, 0, 0, 10, 5), (1, 1, 0, 2, 0), (1, 1, 1, -1, 1)], "slide int, group int, ord int, delay long, duration long")
    assert rows(timeline.flattened(effects, ["slide"]), "group", "ord", "start", "end") == [(0, 0, 10, 15), (1, 0, 17, 17), (1, 1, 14, 15)]
    state = spark.createDataFrame([(1, 1, "show", 5, 5, False, 0.0), (1, 2, "opacity", 0, 10, False, 0.5), (1, 3, "motion", 0, 2, True, 3.0), (1, 4, "motion", 0, 2, False, 9.0)], "shape int, ord int, kind string, start int, end int, hold boolean, value double")
    at = lambda t: [tuple(r) for r in timeline.state_at(state, ["shape"], F.lit(t)).collect()]
    assert at(4) == [(1, False, 0.5, 1.0, 3.0)]
    assert at(20) == [(1, True, 1.0, 1.0, 3.0)]


def test_job_states_fold_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(jobs, "PIECE", 3)
    asks = ["run", "fail", "retry", "run", "finish", "run", "bogus", "retry"]
    df = spark.createDataFrame([(7, i, i, a) for i, a in enumerate(asks)] + [(8, 0, 0, "retry")], "job long, at long, seq long, request string")
    assert rows(jobs.final_states(df)) == [(7, "done", 3, 8), (8, "pending", 1, 1)]
