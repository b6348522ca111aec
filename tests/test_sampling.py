import pytest
from pyspark.sql import functions as F

from gradeloom.operators import joins, sampling
from gradeloom.operators.joins import anti_join_by_key
from gradeloom.operators.row_index import with_row_index


def numbers(spark, n, partitions=4):
    return spark.range(n).withColumnRenamed("id", "par_id").repartition(partitions)


def ids(df, column="par_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_samples_do_not_depend_on_the_partitioning(spark):
    draws = [
        lambda df: ids(sampling.sample_n(df, 137)),
        lambda df: ids(sampling.sample_frac(df, 0.31)),
        lambda df: sorted(map(tuple, sampling.shuffle_rows(df).collect())),
    ]
    for draw in draws:
        assert draw(numbers(spark, 1000, 1)) == draw(numbers(spark, 1000, 4)) == draw(numbers(spark, 1000, 200))


def test_seeds_draw_different_rows(spark):
    df = numbers(spark, 1000)
    a, b = (set(ids(sampling.sample_n(df, 300, seed=seed))) for seed in (1, 2))
    assert a != b and 50 < len(a & b) < 130


def test_short_supply_is_clamped_or_fails(spark):
    df = numbers(spark, 10)
    assert len(ids(sampling.sample_n(df, 11))) == 10
    assert len(ids(sampling.sample_n(df, 10, on_short="error"))) == 10
    assert ids(sampling.sample_n(df, 0)) == []
    with pytest.raises(ValueError, match="11 of 10"):
        sampling.sample_n(df, 11, on_short="error")
    with pytest.raises(ValueError, match="negative"):
        sampling.sample_n(df, -1)


@pytest.mark.parametrize("size, drawn", [(3, 2), (5, 2), (7, 4), (0, 0)])
def test_half_rows_go_to_the_even_number(spark, size, drawn):
    assert len(ids(sampling.sample_frac(numbers(spark, size), 0.5))) == drawn


def test_copies_at_the_cut_are_counted_exactly(spark):
    copies = numbers(spark, 600).select(F.lit(1).alias("par_id"), F.lit("x").alias("text"))
    others = numbers(spark, 400).select((F.col("par_id") + 2).cast("int").alias("par_id"), F.lit("y").alias("text"))
    df = copies.union(others)
    drawn = [sampling.sample_n(df.repartition(k), 500) for k in (1, 7)]
    counts = [sorted(map(tuple, d.groupBy("par_id").count().collect())) for d in drawn]
    assert counts[0] == counts[1] and drawn[0].count() == 500
    # Same key, different rows: the draw among them depends on the rows only.
    keyed = df.withColumn("text", F.when(F.col("par_id") == 1, F.monotonically_increasing_id().cast("string")).otherwise("y"))
    keyed = spark.createDataFrame(keyed.collect(), keyed.schema)
    a, b = (sorted(map(tuple, sampling.sample_n(keyed.repartition(k), 500, key=["par_id"]).collect())) for k in (1, 7))
    assert a == b and len(a) == 500


def test_shuffle_spreads_a_hot_key(spark):
    df = spark.range(900).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("par_id"))
    shuffled = sampling.shuffle_rows(df)
    assert ids(shuffled) == ids(df) and ids(shuffled, "row_idx") == list(range(900))


def test_shuffle_replaces_positions(spark):
    df = numbers(spark, 50).withColumn("row_idx", F.col("par_id") + 100)
    shuffled = sampling.shuffle_rows(df, key=["par_id"])
    assert shuffled.columns[-1] == "row_idx" and ids(shuffled, "row_idx") == list(range(50))
    again = sampling.shuffle_rows(df.repartition(7), key=["par_id"])
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, again.collect()))


def test_no_id_is_on_both_sides_of_a_split(spark):
    df = spark.createDataFrame([(i % 5 or None, "orig", str(i)) for i in range(60)], "par_id int, origin string, copy_no string")
    train, valid = sampling.split_train_valid(df, 0.05)
    sides = [{r["par_id"] for r in side.collect()} for side in (train, valid)]
    assert train.count() == 3 and not sides[0] & sides[1]
    drawn_null = df.filter("par_id IS NULL").limit(1)
    assert anti_join_by_key(df, drawn_null).filter("par_id IS NULL").count() == 0


def test_row_index_follows_the_order(spark):
    df = spark.range(2000).select((F.lit(1999) - F.col("id")).alias("x"), F.lit("same").alias("y")).repartition(13)
    indexed = with_row_index(df, "x")
    assert indexed.filter("x <> row_idx").count() == 0 and indexed.count() == 2000
    equal = with_row_index(df, "y")
    assert ids(equal, "row_idx") == list(range(2000))
    assert ids(with_row_index(df), "row_idx") == list(range(2000))


def training(spark, positives, negatives, extra):
    train = spark.range(positives + negatives).select(
        F.col("id").alias("par_id"), (F.col("id") < positives).cast("int").alias("label"), F.lit("t").alias("text")
    )
    aug = spark.range(extra).select((F.col("id") % positives).alias("par_id"), F.lit(1).alias("label"), F.lit("bt").alias("text"), (F.col("id") / positives).cast("int").cast("string").alias("copy_no"))
    return train, aug


@pytest.mark.parametrize("down, up, extra, zeros, added", [(3, 2.5, 10, 60, 10), (3, 1.5, 20, 60, 10), (2.5, 1.0, 5, 50, 0), (1.125, 2.5, 60, 22, 30)])
def test_rebalanced_sizes(spark, down, up, extra, zeros, added):
    result = sampling.rebalance(*training(spark, 20, 100, extra), down_ratio=down, up_ratio=up)
    counts = {(r["label"], r["origin"]): r["count"] for r in result.groupBy("label", "origin").count().collect()}
    assert counts.get((1, "orig")) == 20 and counts.get((0, "orig")) == zeros and counts.get((1, "aug"), 0) == added
    assert ids(result, "row_idx") == list(range(20 + zeros + added))


def test_rebalance_needs_enough_negatives(spark):
    with pytest.raises(ValueError, match="120 of 100"):
        sampling.rebalance(*training(spark, 20, 100, 5), down_ratio=6)


def test_split_shares_no_id_and_counts_what_it_loses(spark):
    balanced = sampling.rebalance(*training(spark, 50, 200, 50))
    train, valid = sampling.split_train_valid(balanced)
    total = balanced.count()
    assert train.count() == round(0.8 * total)
    assert not set(ids(train)) & set(ids(valid))
    assert sampling.lost_rows(balanced, train, valid) == total - train.count() - valid.count() > 0
    again, _ = sampling.split_train_valid(balanced.repartition(3))
    assert ids(train) == ids(again)
    # The draw is not the same as that of the negatives.
    share = train.filter("label = 0").count() / balanced.filter("label = 0").count()
    assert 0.65 < share < 0.95


def test_repeated_list_entries_stay_apart(spark):
    df = spark.createDataFrame([(0, 5, 0), (1, 5, 0), (2, 6, 1)], "row_idx bigint, par_id bigint, label int")
    keyed = sampling.with_row_key(df, "orig").select("par_id", "origin", "copy_no").collect()
    assert len(set(map(tuple, keyed))) == 3


def test_concat_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "par_id int, text string")
    b = spark.createDataFrame([(0.5, 2)], "score double, par_id int")
    assert sorted(map(tuple, sampling.concat(a, b).collect()), key=str) == [(1, "x", None), (2, None, 0.5)]


def test_anti_join_drops_every_copy(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "par_id int")
    assert ids(joins.anti_join_by_key(df, df.filter("par_id = 1"))) == [2]


@pytest.mark.parametrize("frac", [0.0, 0.1, 0.5, 0.8, 1.0])
def test_ids_are_split_as_a_whole(spark, frac):
    sizes = {i: 1 + i % 5 for i in range(60)} | {None: 9, 1000: 120}
    rows = [(i, copy) for i, n in sizes.items() for copy in range(n)]
    df = spark.createDataFrame(rows, "par_id long, copy int")
    sides = [sorted(((r["par_id"] is None, r["par_id"] or 0, r["copy"]) for r in side.collect())) for side in sampling.split_by_id(df, frac)]
    again = sampling.split_by_id(df.repartition(7), frac)[0].count()
    assert sorted(sides[0] + sides[1]) == sorted((i is None, i or 0, c) for i, c in rows) and again == len(sides[0])
    assert not {x[:2] for x in sides[0]} & {x[:2] for x in sides[1]}
    assert abs(len(sides[0]) - round(frac * len(rows))) <= max(sizes.values()) / 2
