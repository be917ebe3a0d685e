"""Hot-key handling gives the same rows as the plain forms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.functions.scale import HOT_KEYS_MAX, join_groups, largest_groups, number_rows, top_per_group
from shelfmark.operators import dedup


def skewed(spark, n=3000):
    """A third of all rows under one key."""
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("k"))


def test_hot_keys_are_few_and_found(spark):
    counts = skewed(spark).groupBy("k").agg(F.count("*").alias("n"))
    assert [r.k for r in largest_groups(counts, "n", floor=100).collect()] == ["hot"]
    assert largest_groups(counts, "n").count() == min(counts.count(), HOT_KEYS_MAX)


def test_hot_keys_of_equal_size_are_the_same_in_every_plan(spark):
    counts = spark.range(5 * HOT_KEYS_MAX).select(F.md5(F.col("id").cast("string").cast("binary")).alias("k"), F.lit(2).alias("n"))
    one = {r.k for r in largest_groups(counts.repartition(3, "k"), "n").collect()}
    other = {r.k for r in largest_groups(counts.repartition(7), "n").collect()}
    assert one == other and len(one) == HOT_KEYS_MAX


def test_join_groups_splits_hot_keys_without_losing_rows(spark):
    rows = skewed(spark)
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    split = join_groups(rows, groups, ["k"], "n", "id", floor=100)
    plain = rows.join(groups, "k")
    assert sorted(split.select("id", "k", "n", "first").collect()) == sorted(plain.select("id", "k", "n", "first").collect())
    # rows of the hot key really lie in many partitions
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = join_groups(rows, groups, ["k"], "n", "id", floor=100).where("k = 'hot'")
        assert spread.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_left_join_keeps_rows_without_a_group(spark):
    rows = skewed(spark)
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 10")
    kept = join_groups(rows, groups, ["k"], "n", "id", how="left", floor=100)
    assert kept.count() == 3000 and kept.where("n is null").count() == 2000


def test_number_rows_is_gap_free_and_equal_with_and_without_ranges(spark):
    rows = skewed(spark)
    ranged = number_rows(rows, ["k"], "id", "o", floor=100)
    w = Window.partitionBy("k").orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id")
    plain = rows.withColumn("o", F.row_number().over(w).cast("long"))
    assert sorted(ranged.select("id", "o").collect()) == sorted(plain.select("id", "o").collect())


def test_top_per_group(spark):
    got = top_per_group(skewed(spark), ["k"], [F.asc("id")], 2).where("k = 'hot'").collect()
    assert sorted(r.id for r in got) == [0, 3]


def test_members_of_a_hot_group_are_complete(spark):
    files = spark.range(900).select(
        F.col("id").cast("string").alias("file_id"),
        F.concat(F.lit("/a/f"), "id").alias("path"),
        F.concat(F.lit("f"), "id").alias("name"),
        F.lit(".txt").alias("extension"),
        F.lit(2048).cast("long").alias("size_bytes"),
        F.when(F.col("id") % 3 == 0, "h").otherwise(F.concat(F.lit("x"), F.col("id") % 50)).alias("hash_quick"),
        F.timestamp_seconds("id").alias("modified_at"),
        F.lit(0).alias("access_count"),
    ).withColumn("hash_full", F.col("hash_quick"))
    groups = dedup.exact_groups(files)
    members = dedup.exact_members(files, groups, floor=50)
    assert members.count() == 900
    hot = members.join(groups.where("hash_full = 'h'").select("group_id"), "group_id")
    assert hot.count() == 300 and hot.where("is_canonical").count() == 1


def components_of(edges):
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in parent}


def test_star_components_of_random_graphs(spark):
    import random

    from shelfmark.functions.components import star_components

    rng = random.Random(3)
    for n, m in ((300, 280), (1, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = star_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
        assert {r.id: r.label for r in got} == components_of(edges) and len(got) == len({r.id for r in got})


def test_star_components_of_a_chain_and_of_hubs(spark):
    """A chain in shuffled order, a hub with the largest id and one with the smallest."""
    from pyspark.sql import functions as F

    from shelfmark.functions.components import star_components

    chain = spark.range(10_000).select(((F.col("id") * 7919) % 10_007).alias("a"), (((F.col("id") + 1) * 7919) % 10_007).alias("b"))
    low = spark.range(100_001, 400_000).select(F.lit(100_000).cast("long").alias("a"), F.col("id").alias("b"))
    high = spark.range(1_000_000, 1_300_000).select(F.col("id").alias("a"), F.lit(9_000_000).cast("long").alias("b"))
    got = star_components(chain.unionByName(low).unionByName(high), "a", "b")
    sizes = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert sizes == {0: 10_001, 100_000: 300_000, 1_000_000: 300_001}
    assert got.where("label > id").isEmpty()


def test_path_conflicts_repeat_no_rows_for_distinct_counts(spark):
    """F32: two distinct counts in one aggregation held every row several times."""
    from shelfmark.operators import compare

    rows = [("p", "a", "1"), ("p", "b", "2"), ("p", "b", "2"), ("q", "a", "1"), ("q", "b", "1"), ("r", "a", "1"), ("r", "a", "2"),
            ("s", None, "1"), ("s", "a", "2"), (None, "a", "1"), (None, "b", "2"), ("t", "a", None), ("t", "b", "2")]
    found = compare.path_conflicts(spark.createDataFrame(rows, "relative_path string, root_id string, hash_quick string"))
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.relative_path, r.version_count, r.root_count, r.copies) for r in found.collect()}
    assert got == {("p", 2, 2, 3), (None, 2, 2, 2)}
