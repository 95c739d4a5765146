"""The pN_ queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlane.llm.bpe import encoded
from courtlane.llm.leaks import leaked_items
from courtlane.llm.nearest import hits_with_impulse
from courtlane.llm.quantiles import SPEED_PROBS, checked_percentiles, coarse_percentiles, speed_digests, speed_percentiles
from courtlane.llm.survivors import best_observations, merged_observations
from courtlane.llm.truncation import cut_documents, cut_shares
from courtlane.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return best_observations(table(spark, sf, "ball_raw"))


def p2_merged(spark: SparkSession, sf: str) -> DataFrame:
    return merged_observations(table(spark, sf, "ball_raw"))


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded to 6 decimals, as a key of a digest stands for values within 2**-33 of each other."""
    p = speed_percentiles(table(spark, sf, "sidecar"))
    return p.withColumns({c: F.round(c, 6) for c in SPEED_PROBS})


def p4_digests(spark: SparkSession, sf: str) -> DataFrame:
    return speed_digests(table(spark, sf, "sidecar"))


def p4_percentiles_coarse(spark: SparkSession, sf: str) -> DataFrame:
    """Folded digests: rank error 5 %. No SQL: p4_rank_errors holds these percentiles against the values."""
    return coarse_percentiles(table(spark, sf, "sidecar"))


def p4_rank_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the ranks of p4_percentiles_coarse are off by rank_error at most."""
    return checked_percentiles(table(spark, sf, "sidecar"))


def p6_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return hits_with_impulse(table(spark, sf, "hit_event"), table(spark, sf, "audio_impulse"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_nearest(spark, sf).select("hit_id", "audio_id").distinct()


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return cut_documents(table(spark, sf, "documents"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return cut_shares(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_merged, p4_percentiles, p4_digests, p4_percentiles_coarse, p4_rank_errors, p6_found, p6_nearest, p7_ids, p8_found, p9_found, p9_shares)}
