import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featsieve.functions import with_row_key
from featsieve.operators import prep, split, target
from featsieve.operators.quantiles import exact_quantiles

ROWS = [("red", 4.0, 7, 0.5, "no"), ("blue", None, 8, 0.25, "yes"), (None, 6.0, 9, 0.125, "yes"), ("red", 9.0, 10, None, "no"), ("green", 1.0, 11, 0.75, "yes")]
SCHEMA = "colour string, width double, tag int, share double, kept string"


def test_features_are_numbers_first_and_keep_their_values(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = prep.fit(prep.drop_roles(df, "kept", ["tag"]), "kept")
    assert model.features == ["width", "share", "colour"]
    out = model.transform(df, ["tag"]).orderBy("tag").collect()
    assert [r["label"] for r in out] == [0, 1, 1, 0, 1]
    assert [r["colour"] for r in out] == [2.0, 0.0, 2.0, 2.0, 1.0]  # blue, green, red; the gap takes the most frequent
    for name, values in (("width", [4.0, 5.0, 6.0, 9.0, 1.0]), ("share", [0.5, 0.25, 0.125, 0.375, 0.75])):
        x = np.asarray(values)
        assert np.allclose([r[name] for r in out], (x - x.mean()) / x.std(), atol=1e-6)
    assert [(r["feature"], r["fill"]) for r in model.artifacts().orderBy("pos").collect()] == [("width", "5.0"), ("share", "0.375"), ("colour", "red")]


def test_a_missing_label_is_no_class(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "y string")
    assert [tuple(r) for r in prep.encode_labels(df, "y").orderBy("code").collect()] == [("a", 0), ("b", 1)]


def test_a_frequent_unseen_value_is_spread(spark):
    """90 % of the rows hold one value the dictionary lacks: no task gets much more than its share."""
    known = spark.range(500).selectExpr("concat('v', id) as value", "1 as n", "cast(id as int) as code")
    df = spark.range(40_000).selectExpr("id", "case when id % 10 > 0 then 'new' else concat('v', id % 600) end as c")
    out = prep.encode_column(df, "c", known, "code", head_values=50)
    want = {f"v{i}": i for i in range(500)}
    got = out.groupBy("c", "code").count().collect()
    assert sum(r["count"] for r in got) == 40_000 and all(r["code"] == want.get(r["c"], -1) for r in got)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = prep.encode_column(df, "c", known, "code", head_values=50).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(r["count"] for r in sizes) < 2 * 40_000 / 4


def test_unseen_category_and_label(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).drop("tag")
    model = prep.fit(df, "kept")
    row = model.transform(spark.createDataFrame([("mauve", math.inf, 0.5, "yes")], df.schema)).head()
    assert row["colour"] == -1.0 and math.isfinite(row["width"])
    with pytest.raises(Exception, match="label not seen"):
        model.transform(spark.createDataFrame([("red", 1.0, 0.5, "maybe")], df.schema)).collect()


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(5.0, None, "a"), (5.0, None, "b")], "c double, e double, y string")
    with pytest.raises(ValueError, match="without any value"):
        prep.fit(df, "y")
    assert {r["c"] for r in prep.fit(df.drop("e"), "y").transform(df.drop("e")).collect()} == {0.0}
    with pytest.raises(ValueError):
        prep.drop_roles(df, "y", ["y"])
    with pytest.raises(ValueError):
        prep.project_features(df, "y", ["nope"])


@pytest.mark.parametrize("limit", [5_000_000, 3])
def test_exact_quantiles_match_numpy(spark, limit):
    rng = np.random.default_rng(0)
    x = np.where(rng.random(5000) < 0.4, 7.0, rng.normal(size=5000))
    df = spark.createDataFrame([(float(v), None if i % 3 else float(i)) for i, v in enumerate(x)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.5, 0.01, 0.9, 1.0], max_ranked_rows=limit)
    b = np.arange(0, 5000, 3, dtype=float)
    for p in (0.5, 0.01, 0.9, 1.0):
        assert got[("a", p)] == pytest.approx(np.quantile(x, p), abs=1e-12) and got[("b", p)] == pytest.approx(np.quantile(b, p))


def test_large_dictionary_path_equals_plain_path(spark):
    words = spark.range(3000).select(F.lit("f").alias("feature"), F.concat(F.lit("w"), F.md5(F.col("id").cast("string"))).alias("value"), F.lit(1).alias("n"))
    plain, ranged = prep.category_codes(words), prep.category_codes(words, max_plain_rows=10)
    assert plain.exceptAll(ranged).count() == 0 and ranged.count() == 3000
    dictionary = ranged.join(words, ["feature", "value"])
    rows = words.select("value").unionByName(spark.createDataFrame([("absent",), (None,)], "value string"))
    small = prep.encode_column(rows, "value", dictionary, "c")
    spread = prep.encode_column(rows, "value", dictionary, "c", head_values=7)
    assert small.exceptAll(spread).count() == 0 and spread.count() == 3002 and spread.filter("c = -1").count() == 2


def test_row_keys_are_unique_and_stable(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, "").alias("b"))
    first, second = with_row_key(df.repartition(7)), with_row_key(df, copies_per_task=50)
    assert first.select("row_key").distinct().count() == 1000
    assert first.exceptAll(second).count() == 0 and second.count() == 1000


def expected_folds(counts, k):
    order = np.repeat(np.arange(len(counts)), counts)
    return [np.bincount(order[f::k], minlength=len(counts)).tolist() for f in range(k)]


def test_sizes_match_the_dealing_rule():
    counts = {"a": 17, "b": 5, "c": 31}
    got = split.fold_sizes(counts, 4)
    assert [[got[c][f] for c in counts] for f in range(4)] == expected_folds([17, 5, 31], 4)
    sizes = split.holdout_sizes({"a": 5, "b": 5, "c": 1}, 3)
    assert sum(v[0] for v in sizes.values()) == 3 and all(sum(v) == n for v, n in zip(sizes.values(), (5, 5, 1)))
    big = split.holdout_sizes({"a": 7 * 10**11, "b": 3 * 10**11}, 2 * 10**11)
    assert big == {"a": [14 * 10**10, 56 * 10**10], "b": [6 * 10**10, 24 * 10**10]}


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("rare").alias("y"))
    for make in (lambda d: split.stratified_holdout(d, "y", "key", 7, 0.25), lambda d: split.stratified_folds(d, "y", "key", 5, 7)):
        assert make(df.repartition(1)).exceptAll(make(df.repartition(8))).count() == 0
    folds = split.stratified_folds(df, "y", "key", 5, 7)
    assert {r["count"] for r in folds.filter("y = 'rare'").groupBy("fold").count().collect()} == {40}
    member = split.fold_membership(folds, "key", 5)
    assert member.count() == 10000 and member.filter("split = 'validation'").count() == 2000
    sample = split.stratified_sample(df, "y", "key", 100, 7)
    assert {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()} == {"big": 70, "mid": 20, "rare": 10}
    assert split.stratified_sample(df, "y", "key", 5000, 7).count() == 2000


def test_tiny_classes_survive_splitting(spark):
    df = spark.createDataFrame([(str(i), "a" if i else "b") for i in range(9)], "key string, y string")
    assert split.stratified_folds(df, "y", "key", 4).count() == 9
    assert split.stratified_holdout(df, "y", "key").filter("split = 'test'").count() == 2
    with pytest.raises(ValueError, match="too few"):
        target.require_feasible(df, "y", 3)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    assert {r["y"]: r["weight"] for r in target.class_weights(df, "y").collect()} == {0: pytest.approx(4 / 6), 1: 2.0}
    assert target.with_class_weight(df, "y").agg(F.sum("weight")).head()[0] == pytest.approx(4.0)


def test_positions_follow_the_shuffled_order(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(500)], "row_key string")
    found = []
    for n in (1, 7):
        ordered = split.shuffled(df.repartition(n), "row_key", 3)
        rows = split.with_position(ordered).collect()
        assert sorted(r["position"] for r in rows) == list(range(500))
        found.append([r["row_key"] for r in sorted(rows, key=lambda r: r["position"])])
        assert found[-1] == [r["row_key"] for r in ordered.collect()]
    assert found[0] == found[1] != sorted(found[0])
    assert split.with_position(split.shuffled(df.limit(0), "row_key")).count() == 0
