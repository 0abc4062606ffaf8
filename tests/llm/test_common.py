from tidemark.llm.common import hot_join, hot_split


def test_hot_joins_lose_no_row(spark):
    large = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)] + [(99, 1), (None, 2)], "key long, v long").repartition(5)
    counts = large.groupBy("key").count().filter("key <> 99").withColumn("name", large["key"] * 10)
    expected = sorted((k * 10, v) for k, v in large.collect() if k is not None and k != 99)
    for small, parts in ((20_000, 1000), (0, 1000), (0, 3), (0, 1)):
        hot, others = hot_split(counts, "count", parts, small)
        assert (others is None) == bool(small) and (bool(small) or hot.count() <= parts)
        assert sorted((r.name, r.v) for r in hot_join(large, hot, others, "key").collect()) == expected
        assert hot_join(large, hot, others, "key", "left").count() == 302
    assert hot_join(large, *hot_split(counts.limit(0), "count"), "key", "left").count() == 302
