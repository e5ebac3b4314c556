"""Alignments of many pairs: as each pair alone, words that repeat in a batch once."""

from pyspark.sql import functions as F

from vellumgrid.operators import text


def test_alignments_are_those_of_each_pair(spark):
    words = [("GOOD", "DOGS"), ("", "AB"), ("AB", ""), (None, "A"), ("GOOD", "DOGS"), ("ABCD", "BCDA")]
    costs = {("O", "D"): 0.5, ("G", "%"): 0.25}
    rows = spark.createDataFrame([(k, o, i, 7.0) for k, (o, i) in enumerate(words * 20)], "k long, observed string, intended string, cost double")
    found = text.alignments(rows, costs)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = found.orderBy("k").select("k", "cost", F.transform("steps", lambda s: F.concat(s["o"], s["i"])).alias("s")).collect()
    want = [text.align(o or "", i or "", costs) for o, i in words * 20]
    assert [(r.k, r.cost, r.s) for r in got] == [(k, c, [a + b for a, b in s]) for k, (c, s) in enumerate(want)]
