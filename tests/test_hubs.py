import random

from pyspark.sql import functions as F

from deltaloom.operators import graph


def test_hubs_are_cut_before_the_shuffle(spark):
    """A hub's context is the first edges by priority, and each task sends a quota of them and a count."""
    r = random.Random(3)
    relations = list(graph.PRIORITY)
    rows = [("hub", f"t{i}", r.choice(relations)) for i in range(4000)] + [(f"f{i}", "hub", r.choice(relations)) for i in range(3000)] + [("a", "b", relations[0]), ("b", "a", relations[1])]
    new = spark.createDataFrame(rows, "from_object string, to_label string, relation string").repartition(5)
    new = new.withColumns({"to_candidates": F.array("to_label"), "resolution": F.lit("resolved_static")})
    old = new.where("from_object <> 'b'")
    changed = spark.createDataFrame([("hub",), ("a",), ("nobody",)], "object_key string")
    got = graph.selected_context(graph.context_planes(old, new, changed), 8)
    want = {}
    for k in ("hub", "a"):
        for side, edges in (("new_outgoing", [x for x in rows if x[0] == k]), ("old_reverse", [x for x in rows if x[1] == k and x[0] != "b"]), ("new_reverse", [x for x in rows if x[1] == k])):
            ranked = sorted(edges, key=lambda x: (graph.PRIORITY[x[2]], x[1], x[0], x[2]))
            want |= {(k, side, i + 1): (*x, max(0, len(edges) - 8)) for i, x in enumerate(ranked[:8])}
    assert {(x.object_key, x.side, x.rank): (x.from_object, x.to_label, x.relation, x.omitted) for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert graph.selected_context(new.where("false").withColumns({"object_key": F.lit("x"), "side": F.lit("y")})).count() == 0
