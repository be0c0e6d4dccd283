"""Similarity matching of names: exact top-k candidates, statuses, mappings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions.text import STRING_WEIGHT, TOKEN_WEIGHT, let, normalize, similarity_from_soft, token_similarity, tokens_of_key
from ledgerfold.operators.relational import spread

# --- fixed values: score levels and the penalty for another unit of measure ---
EXACT_SCORE, AUTO_SCORE, WEAK_SCORE = 0.999, 0.85, 0.45
BASIS_PENALTY = 0.6
CANDIDATES = 5

POOL_BLOCK = 512  # pool entries scored per row of work
BROADCAST_POOL = 32_768  # pool entries (of bounded text) that may be broadcast
BROADCAST_TEXT = 16 * 1024 * 1024
NAME_SALTS = 64
SLACK = 1e-9  # bounds and scores are rounded apart


def status_for(score: Column) -> Column:
    return (
        F.when(score >= EXACT_SCORE, F.lit("exact"))
        .when(score >= AUTO_SCORE, F.lit("auto"))
        .when(score >= WEAK_SCORE, F.lit("weak"))
        .otherwise(F.lit("none"))
    )


def basis_compatible(wanted: Column, offered: Column) -> Column:
    """No demand, no statement, 'other', or the same unit."""
    return wanted.isNull() | offered.isNull() | (offered == "other") | (wanted == offered)


def _packed_pool(pool: DataFrame, blocks: int) -> DataFrame:
    """Pool entries in blocks, with the distinct stems of a block as an inverted index.

    An entry names its stems by their places in the block's list, so that what is
    known of a stem serves every entry that holds it.
    """
    keyed = pool.withColumn("match_key", normalize(F.col("name"))).select(
        F.pmod(F.xxhash64("id", "pos"), F.lit(blocks)).cast("int").alias("block"),
        "id", "name", "basis", "pos", "match_key", tokens_of_key(F.col("match_key")).alias("tokens"),
    )
    packed = keyed.groupBy("block").agg(
        F.collect_list(F.struct("id", "name", "basis", "pos", "match_key", "tokens")).alias("raw_entries")
    )
    stems = F.array_distinct(F.flatten(F.transform("raw_entries", lambda e: e["tokens"])))
    indexed = packed.withColumn("stems", stems).withColumn(
        "places", F.map_from_arrays(F.col("stems"), F.transform("stems", lambda _, i: i))
    )
    entries = F.transform(
        "raw_entries",
        lambda e: F.struct(
            e["id"].alias("id"), e["name"].alias("name"), e["basis"].alias("basis"), e["pos"].alias("pos"), e["match_key"].alias("match_key"),
            F.transform(e["tokens"], lambda t: F.element_at("places", t)).alias("at"),
        ),
    )
    return indexed.select("block", "stems", entries.alias("entries"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _soft_scores(entries: Column, scores: Column) -> Column:
    """Soft Dice coefficient of a name with every entry.

    ``scores`` has a row per stem of the name and a place per stem of the block:
    every two stems have been compared once.
    """
    of_stem = F.when(F.size(scores) > 0, F.transform(F.get(scores, 0), lambda _, i: F.array_max(F.transform(scores, lambda row: F.get(row, i)))))

    def soft(best_of_stem: Column) -> Column:
        def one(e: Column) -> Column:
            there = _total(F.transform(scores, lambda row: F.array_max(F.transform(e["at"], lambda i: F.get(row, i))))) / F.size(scores)
            back = _total(F.transform(e["at"], lambda i: F.get(best_of_stem, i))) / F.size(e["at"])
            return F.when((F.size(scores) == 0) | (F.size(e["at"]) == 0), F.lit(0.0)).otherwise((there + back) / 2)

        return F.transform(entries, one)

    return let(of_stem, soft)


def _score_ceiling(soft: Column, key_a: Column, key_b: Column) -> Column:
    """No similarity is above this: the edit ratio taken from the lengths alone."""
    lengths = F.greatest(F.length(key_a), F.length(key_b))
    lev = F.when(lengths == 0, F.lit(1.0)).otherwise(F.least(F.length(key_a), F.length(key_b)) / lengths)
    return F.when(key_a == key_b, F.lit(1.0)).otherwise(F.greatest(soft * TOKEN_WEIGHT + lev * STRING_WEIGHT, lev))


def rank_candidates(names: DataFrame, pool: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """The ``limit`` most similar pool entries of every name, exactly.

    ``names(key, name, basis)`` holds each name once; ``pool(id, name, basis,
    pos)`` is the list to choose from.  No pair is ever a row: the pool is packed
    into blocks of bounded size, a name meets each block once by an equi-join on
    the block number, scores its entries in place and keeps the best ``limit``;
    the winners of the blocks are ranked in the end.  A pool whose size was
    measured to be small is broadcast; a larger one is shuffled, each block
    being replicated over salts so that the names of a block spread out.

    Inside a block the stems of a name are compared with the distinct stems once,
    whatever number of entries holds them.  What they give bounds every entry's
    score from below (the edit ratio being 0) and from above (what the lengths
    allow); whole names are compared only for entries that can still be among the
    best ``limit``.
    """
    size = pool.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("chars")).first()
    blocks = max(1, math.ceil(size["n"] / POOL_BLOCK))
    packed = _packed_pool(pool, blocks)
    left = (
        spread(names, ["key"])
        .select("key", F.col("name").alias("wanted"), F.col("basis").alias("wanted_basis"))
        .withColumn("match_key", normalize(F.col("wanted")))
        .withColumn("tokens", tokens_of_key(F.col("match_key")))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    if size["n"] <= BROADCAST_POOL and size["chars"] <= BROADCAST_TEXT:
        met = left.join(F.broadcast(packed), "block")
    else:
        salts = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(NAME_SALTS - 1))))
        met = left.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(NAME_SALTS)).cast("int")).join(
            salts, ["block", "salt"]
        )

    key = F.col("match_key")
    penalty = lambda e: F.when(basis_compatible(F.col("wanted_basis"), e["basis"]), 1.0).otherwise(BASIS_PENALTY)
    scores = F.transform("tokens", lambda t: F.transform("stems", lambda o: token_similarity(t, o)))

    def bounded(soft: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            floor = F.when((key == "") | (e["match_key"] == ""), 0.0).otherwise(F.get(soft, i) * TOKEN_WEIGHT) * penalty(e)
            ceiling = _score_ceiling(F.get(soft, i), key, e["match_key"]) * penalty(e)
            return F.struct(i.alias("i"), F.get(soft, i).alias("soft"), floor.alias("floor"), ceiling.alias("ceiling"))

        return F.transform("entries", one)

    def hopeful(bounds: Column) -> Column:
        least = F.coalesce(F.get(F.sort_array(F.transform(bounds, lambda x: x["floor"]), asc=False), limit - 1), F.lit(0.0))
        return let(least, lambda level: F.filter(bounds, lambda x: x["ceiling"] >= level - SLACK))

    def compared(x: Column) -> Column:
        return let(
            F.get("entries", x["i"]),
            lambda e: F.struct(
                e["id"].alias("id"), e["name"].alias("name"), e["basis"].alias("basis"), e["pos"].alias("pos"),
                similarity_from_soft(key, e["match_key"], x["soft"]).alias("raw"),
            ),
        )

    # each step is bound by ``let``: a column of its own would be worked out anew for every entry
    raw = let(scores, lambda rows: let(_soft_scores(F.col("entries"), rows), lambda soft: let(bounded(soft), lambda bounds: F.transform(hopeful(bounds), compared))))
    # Field order is sort order: best score, then Russian collation, then pool order.
    scored = F.transform(
        F.col("raw_scores"),
        lambda e: F.struct(
            F.when(basis_compatible(F.col("wanted_basis"), e["basis"]), -e["raw"])
            .otherwise(-e["raw"] * BASIS_PENALTY)
            .alias("minus_score"),
            F.collate(e["name"], "ru").alias("sort_name"),
            e["pos"].alias("pos"),
            e["id"].alias("id"),
            e["name"].alias("name"),
            e["basis"].alias("basis"),
            e["raw"].alias("raw_score"),
        ),
    )
    best = (
        met.withColumn("raw_scores", raw)
        .select("key", "wanted_basis", F.slice(F.sort_array(scored), 1, limit).alias("best"))
        .select("key", "wanted_basis", F.explode("best").alias("c"))
    )
    order = Window.partitionBy("key").orderBy("c.minus_score", "c.sort_name", "c.pos")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select(
            "key",
            "rank",
            F.col("c.id").alias("id"),
            F.col("c.name").alias("name"),
            F.col("c.basis").alias("basis"),
            (-F.col("c.minus_score")).alias("score"),
            F.col("c.raw_score").alias("raw_score"),
            (~basis_compatible(F.col("wanted_basis"), F.col("c.basis"))).alias("basis_mismatch"),
        )
    )


def _best(names: DataFrame, candidates: DataFrame, chosen: str) -> DataFrame:
    top = candidates.filter("rank = 1").select("key", F.col("id").alias("__id"), "score")
    score = F.coalesce("score", F.lit(0.0))
    return names.select("key").join(top, "key", "left").select(
        "key",
        F.when(score >= WEAK_SCORE, F.col("__id")).alias(chosen),
        score.alias("score"),
        status_for(score).alias("status"),
        F.lit(True).alias("auto"),
    )


def norm_names(categories: DataFrame) -> DataFrame:
    return categories.select(F.col("category_key").alias("key"), "name", "basis")


def norm_pool(norms: DataFrame) -> DataFrame:
    return norms.select("id", "name", "basis", "pos")


def norm_mapping(categories: DataFrame, candidates: DataFrame) -> DataFrame:
    """Form category to norm, as a suggestion in mode 'single'."""
    best = _best(norm_names(categories), candidates, "entry_id")
    return best.select(
        "key",
        F.lit("single").alias("mode"),
        "entry_id",
        "score",
        "status",
        "auto",
        F.lit("").alias("expression"),
        F.lit(None).cast("double").alias("manual_mass"),
        F.lit(None).cast("double").alias("manual_volume"),
    )


def registry_names(registry_categories: DataFrame) -> DataFrame:
    no_basis = F.lit(None).cast("string").alias("basis")
    return registry_categories.select(F.col("category_key").alias("key"), "name", no_basis)


def category_pool(categories: DataFrame) -> DataFrame:
    return categories.select(
        F.col("category_key").alias("id"), "name", "basis", F.col("first_idx").cast("bigint").alias("pos")
    )


def registry_mapping(registry_categories: DataFrame, candidates: DataFrame) -> DataFrame:
    return _best(registry_names(registry_categories), candidates, "template_key")


def zone_names(registry_zones: DataFrame) -> DataFrame:
    no_basis = F.lit(None).cast("string").alias("basis")
    return registry_zones.select(F.col("zone_key").alias("key"), "name", no_basis)


def zone_pool(template_zones: DataFrame) -> DataFrame:
    return template_zones.select(
        F.col("zone_key").alias("id"),
        "name",
        F.lit(None).cast("string").alias("basis"),
        F.col("first_idx").cast("bigint").alias("pos"),
    )


def zone_mapping(registry_zones: DataFrame, candidates: DataFrame) -> DataFrame:
    return _best(zone_names(registry_zones), candidates, "template_key")


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """Candidates of a name as one array (at most ``limit`` of them)."""
    fields = F.struct("rank", "id", "name", "basis", "score", "raw_score", "basis_mismatch")
    return candidates.groupBy("key").agg(F.sort_array(F.collect_list(fields)).alias("candidates"))


def status_histogram(mapping: DataFrame) -> DataFrame:
    """Mappings per status; those set by hand count as manual."""
    shown = F.when(~F.col("auto"), F.lit("manual")).otherwise(F.col("status"))
    return mapping.groupBy(shown.alias("status")).agg(F.count("*").alias("n"))
