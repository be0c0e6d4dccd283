"""Similarity matching against scoring every pair."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerfold.functions.text import similarity
from ledgerfold.operators import match

WORDS = ["гостиницы", "гостиничный", "магазин", "магазины", "продовольственный", "школа", "школьное", "рынок", "автомойка", "детский", "сад", "и", "т", "м2"]


def _named(n, seed, bases):
    dice = random.Random(seed)
    return [(f"k{i}", " ".join(dice.choices(WORDS, k=dice.randint(0, 4))) or dice.choice([None, "", " ?"]), bases[i % len(bases)]) for i in range(n)]


@pytest.mark.parametrize("block, broadcast", [(512, True), (7, True), (7, False)])
def test_candidates_equal_scores_of_all_pairs(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(match, "POOL_BLOCK", block)
    if not broadcast:
        monkeypatch.setattr(match, "BROADCAST_POOL", 0)
        monkeypatch.setattr(match, "NAME_SALTS", 3)
    names = spark.createDataFrame(_named(40, 1, ["person", None, "other"]), "key string, name string, basis string")
    pool = spark.createDataFrame([(*r, i) for i, r in enumerate(_named(60, 2, ["person", "place", None, "other"]))], "id string, name string, basis string, pos bigint")
    got = match.rank_candidates(names, pool).select("key", "rank", "id", F.round("score", 9), F.round("raw_score", 9), "basis_mismatch")
    offered = pool.select("id", F.col("name").alias("offered"), F.col("basis").alias("offered_basis"), "pos")
    fits = match.basis_compatible(F.col("basis"), F.col("offered_basis"))
    scored = names.crossJoin(offered).withColumn("raw", similarity(F.col("name"), F.col("offered"))).withColumn("fits", fits)
    scored = scored.withColumn("score", F.when(F.col("fits"), F.col("raw")).otherwise(F.col("raw") * match.BASIS_PENALTY))
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.collate("offered", "ru"), "pos")
    best = scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("key", "rank", "id", F.round("score", 9), F.round("raw", 9), ~F.col("fits"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, best.collect()))


def test_only_hopeful_entries_are_compared_whole(spark):
    """What the bounds leave out could not have been among the best."""
    a, b = F.lit("магазин продовольственный"), F.lit("школа")
    soft = F.lit(0.2)
    row = spark.range(1).select(match._score_ceiling(soft, a, b).alias("most"), match.similarity_from_soft(a, b, soft).alias("score")).first()
    assert row["score"] <= row["most"] == pytest.approx(0.2 * 0.85 + 0.15 * 5 / 25)


def test_no_names_or_no_pool(spark):
    names = spark.createDataFrame([("a", "школа", None)], "key string, name string, basis string")
    pool = spark.createDataFrame([("n1", "школа", None, 0)], "id string, name string, basis string, pos bigint")
    assert match.rank_candidates(names, pool.limit(0)).count() == 0
    assert match.rank_candidates(names.limit(0), pool).count() == 0
