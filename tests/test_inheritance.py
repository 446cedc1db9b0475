from folioscope.operators import graph


def test_inherited_over_deep_chains_and_cycles(spark):
    rows = [(i, i - 1 if i else None, "root" if i == 0 else None) for i in range(37)]
    rows += [(100, 101, None), (101, 102, None), (102, 101, "cycle"), (103, 103, None), (104, 999, None)]
    got = {r.id: r.font for r in graph.inherited(spark.createDataFrame(rows, "id long, parent long, font string"), ["font"]).collect()}
    assert got == {i: "root" for i in range(37)} | {100: "cycle", 101: "cycle", 102: "cycle", 103: None, 104: None}
