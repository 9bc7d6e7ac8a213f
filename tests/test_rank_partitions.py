"""Ranked values are dealt into partitions that grow with the rows, not with the session's setting."""

from tapeloom.functions import ranks


def test_partitions_of_ranked_values_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "VALUES_PER_PARTITION", 10)
    df = spark.range(200).selectExpr("CAST(id AS STRING) AS code", "id % 3 AS day", "id % 17 AS a", "id % 5 AS b")
    features = {"a": "a", "b": "b"}
    got = ranks.value_ranks(df, features, ["code", "day"], "day", 200)
    assert got.rdd.getNumPartitions() == 40
    assert sorted(got.collect()) == sorted(ranks.value_ranks(df, features, ["code", "day"], "day").collect())
