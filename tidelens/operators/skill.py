"""Uncertainty of skill scores: block bootstrap of the area under the ROC curve, for one score or two side by side."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions import values as V


def weighted_auc(rows: DataFrame, keys: list[str], score: str, pos: str, neg: str) -> DataFrame:
    """(keys, auc) of rows (keys, score, pos, neg: weights), equal scores counting half; null where a class has no weight."""
    g = rows.groupBy(*keys, score).agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg"))
    up = Window.partitionBy(*keys).orderBy(score)
    below = F.sum("neg").over(up) - F.col("neg")
    g = g.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return g.groupBy(*keys).agg(V.ratio(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))


def multiplicities(tiles: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, tile, times): tiles (tile: 0..n-1, one row each) drawn n times with replacement in each draw, by hashes of seed, draw and turn.

    draw -1 has every tile once. Only draws and turns are spread out, not the tiles' rows.
    """
    spark = tiles.sparkSession
    n = tiles.count()
    slots = spark.range(draws * n).select((F.col("id") % draws).alias("draw"), F.floor(F.col("id") / draws).alias("turn")) if n else spark.range(0).select(F.col("id").alias("draw"), F.col("id").alias("turn"))
    tile = F.floor(V.uniform(seed, "bootstrap", F.concat_ws("/", F.col("draw").cast("string"), F.col("turn").cast("string"))) * n)
    drawn = slots.select("draw", tile.alias("tile")).groupBy("draw", "tile").agg(F.count("*").alias("times"))
    return drawn.unionByName(tiles.select(F.lit(-1).cast("long").alias("draw"), F.col("tile").cast("long").alias("tile"), F.lit(1).cast("long").alias("times")))


def block_bootstrap(blocks: DataFrame, scores: list[str], label: str, tile: int, draws: int = 999, seed: int = 1) -> DataFrame:
    """One row for each score, and for two scores their difference (first less second): auc, low and high (2.5 and 97.5 % of draws), draws.

    blocks (bi, bj, label 0 or 1, scores); others are left out. Blocks lie in tiles of tile by tile, numbered by place. A draw takes as many
    tiles as there are, with replacement; its AUC weighs each block by how often its tile was taken. So a draw is a column of
    weights, all draws are one grouping, and blocks meet draws by tile, pre-aggregated by score. Draws that lack a class have no AUC and
    are not counted.
    """
    known = blocks.where(F.col(label).isin(0, 1)).select(F.floor(F.col("bi") / tile).alias("ti"), F.floor(F.col("bj") / tile).alias("tj"), F.col(label).cast("double").alias("y"), *scores)
    # a row a tile, so few
    tiles = known.select("ti", "tj").distinct().withColumn("tile", F.row_number().over(Window.orderBy("ti", "tj")) - 1)
    long = known.select("ti", "tj", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("which"), F.col(s).cast("double").alias("score")) for k, s in enumerate(scores)))).alias("s")).select("ti", "tj", "y", "s.*")
    counts = long.groupBy("ti", "tj", "which", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).join(tiles, ["ti", "tj"])
    rows = counts.join(multiplicities(tiles.select("tile"), draws, seed), "tile").select("draw", "which", "score", (F.col("pos") * F.col("times")).alias("pos"), (F.col("neg") * F.col("times")).alias("neg"))
    auc = weighted_auc(rows, ["draw", "which"], "score", "pos", "neg")
    named = F.element_at(F.array(*(F.lit(s) for s in scores)), F.col("which") + 1)
    each = auc.select("draw", named.alias("score"), "auc")
    if len(scores) == 2:
        pair = auc.groupBy("draw").agg(*(F.max(F.when(F.col("which") == k, F.col("auc"))).alias(f"a{k}") for k in (0, 1)))
        each = each.unionByName(pair.select("draw", F.lit("difference").alias("score"), (F.col("a0") - F.col("a1")).alias("auc")))
    again = F.when(F.col("draw") >= 0, F.col("auc"))
    out = each.groupBy("score").agg(F.max(F.when(F.col("draw") < 0, F.col("auc"))).alias("auc"), F.percentile(again, F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.count(again).alias("draws"))
    return out.select("score", "auc", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "draws")
