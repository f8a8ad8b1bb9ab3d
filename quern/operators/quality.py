"""Plans and profiles over whole tables: media cost, repetition, kinds of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media
from ..functions import text as T


def media_plan(rows: DataFrame, most: int = 12, size: int = 448, each: int = 256, frames: int = 8) -> DataFrame:
    """Rows (dataset, kind, width, height, images, frames) with their tile grid, tiles or frames, and image tokens."""
    budget = media.tile_budget(most, F.greatest("images", F.lit(1)))
    grid = media.tile_grid("width", "height", 1, most, size)
    image = media.tile_count(grid)
    tiles = F.when(F.col("kind") == "video", F.least(F.lit(frames), F.col("frames"))).when(F.col("kind") == "text", 0).otherwise(F.least(image, budget + F.when(budget > 1, 1).otherwise(0)) * F.greatest("images", F.lit(1)))
    out = rows.withColumns({"grid": grid, "tiles": tiles.cast("int")})
    return out.withColumn("image_tokens", media.image_tokens(F.col("tiles"), each))


def media_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("dataset").agg(F.count("*").alias("rows"), F.sum("tiles").cast("long").alias("tiles"), F.sum("image_tokens").cast("long").alias("image_tokens"))


def drop_repetitive(rows: DataFrame, turns: str = "conversations", n: int = 10, threshold: float = 0.4) -> DataFrame:
    """Conversations none of whose gpt turns repeats its n-grams above the threshold."""
    bad = F.exists(F.col(turns), lambda t: (t["from"] == "gpt") & (T.sentence_repetition(t["value"], n) > threshold))
    return rows.where(~bad)


def repetition_report(rows: DataFrame, text: str, by: str, n: int = 10, threshold: float = 0.4) -> DataFrame:
    scored = rows.select(by, T.sentence_repetition(text, n).alias("r"))
    return scored.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("r") > threshold).alias("dropped"), F.avg("r").alias("mean_repetition"))


def question_profile(rows: DataFrame, text: str, by: str, compat: bool = False) -> DataFrame:
    """Per group, how many texts hold a digit, number word or quantity word, or are boolean, whole or decimal."""
    c = F.col(text)
    kinds = {"digit": T.has_digit(c), "number_word": T.has_number_word(c), "quantity_word": T.has_quantity_word(c, compat), "bool_word": T.is_bool_word(c), "digit_string": T.is_digit_string(c), "float_string": T.is_float_string(c)}
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(k).alias(name) for name, k in kinds.items()))
