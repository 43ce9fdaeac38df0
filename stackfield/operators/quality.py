"""Sharpness, ranking and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import map_frames
from ..functions import kernels as K


def score_frames(frames: DataFrame, metric: str = "laplacian", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, frame_index, score): the pixels stay behind, so what follows moves numbers only."""
    if metric not in ("laplacian", "gradient"):
        raise ValueError(f"unknown metric {metric!r}")
    slim = frames.select(*keys, "frame_index", "height", "width", "pixels")
    return map_frames(slim, lambda a: K.quality(a, metric), {"score": "double"}, drop=("height", "width", "pixels"))


def score_colour(frames: DataFrame, metric: str = "laplacian", keys: tuple[str, ...] = ()) -> DataFrame:
    """Scores of colour frames by their luminance."""
    slim = frames.select(*keys, "frame_index", "height", "width", "r", "g", "b")
    return map_frames(slim, lambda r, g, b: K.quality(K.luminance(r, g, b), metric), {"score": "double"}, pixels=("r", "g", "b"), drop=("height", "width", "r", "g", "b"))


def _best(keys: tuple[str, ...]):
    return Window.partitionBy(*(keys or (F.lit(0),))).orderBy(F.desc("score"), "frame_index")


def rank_frames(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """scores with rank from 1; of equal scores the lower index comes first."""
    return scores.withColumn("rank", F.row_number().over(_best(keys)))


def share_kept(n, share: float, least: int = 1):
    """Column of the rounded-up share of n, in single precision."""
    return F.greatest(F.lit(least), F.least(n, F.ceil(n.cast("float") * F.lit(share).cast("float")).cast("long")))


def select_fraction(scores: DataFrame, share: float = 0.25, keys: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """The best share of each group of keys, with rank. least=0 with a share
    within [0, 1] may select none. Ranks and counts are windows over one exchange,
    so scores are made once."""
    counted = rank_frames(scores, keys).withColumn("__n", F.count("*").over(Window.partitionBy(*(keys or (F.lit(0),)))))
    return counted.filter(F.col("rank") <= share_kept(F.col("__n"), share, least)).drop("__n")


def top_n(scores: DataFrame, n: int = 20) -> DataFrame:
    return scores.orderBy(F.desc("score"), "frame_index").limit(n)


def summary(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.max("score").alias("best_score"), F.min("score").alias("worst_score"))


def sample_frames(frames: DataFrame, n: int, count: int = 30) -> DataFrame:
    """count of the n frames, evenly spread; the filter reaches the source."""
    return frames.filter(F.col("frame_index").isin(K.sample_indices(n, count)))
