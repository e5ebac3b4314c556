"""Joins whose rows come from an explode go by key: Spark takes their size for that of the rows before."""

from pyspark.sql import functions as F

from vellumgrid.llm import near_copies, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_fingerprints_are_not_broadcast(spark):
    nodes = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    links = simhash.near_links(nodes.union(nodes.select(F.col("fp").bitwiseXOR(F.lit(1)))))
    assert links.distinct().count() == 2000
    assert "Broadcast" not in plan(links)


def test_bands_of_texts_are_not_broadcast(spark, monkeypatch):
    seen, write = {}, near_copies.write_table

    def recorded(df, name):
        seen[name] = plan(df)
        return write(df, name)

    monkeypatch.setattr(near_copies, "write_table", recorded)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[:50] + [f"x{k % 3}"])) for k in range(9)], "doc_id long, text string")
    assert [r.doc_id for r in near_copies.one_of_each(docs).select("doc_id").collect()] == [0]
    assert "Broadcast" not in seen["shared"] + seen["placed"]
    assert "BroadcastHashJoin [key" not in seen["rest"]
    assert "BroadcastHashJoin [node" not in seen["shingles"]
