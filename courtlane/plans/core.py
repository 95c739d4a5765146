"""The pN_ queries of the core: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courtlane.operators.anomalies import implausible_readings
from courtlane.operators.intervals import match_coverage
from courtlane.operators.sessions import rally_sessions
from courtlane.session import match_info, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return implausible_readings(table(spark, sf, "sidecar"), match_info(spark, sf)).select("match_id", "frame").distinct()


def p1_readings(spark: SparkSession, sf: str) -> DataFrame:
    return implausible_readings(table(spark, sf, "sidecar"), match_info(spark, sf))


def p3_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return rally_sessions(table(spark, sf, "sidecar"), match_info(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_sessions(spark, sf).select("match_id", "start_frame", "end_frame")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return match_coverage(table(spark, sf, "track_range"), table(spark, sf, "rally_segment"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_readings, p3_found, p3_sessions, p5_found)}
