"""One surviving record per group of duplicates, field by field (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lenient_int(text: Column) -> Column:
    """A number spelled as text, its fraction dropped; null for what isn't a finite number (nan, infinity and Java's 1d or 1f included)."""
    v = F.when(text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(text).try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(2.0**31)), v.cast("int"))


def survivors(records: DataFrame, group: list[str], rank: list[Column], roles: dict[str, Column], record_id: str) -> DataFrame:
    """Groups of two or more records: the id of the first record, and for each role that of the first record that qualifies.

    ``rank`` holds the columns that rank a record, the larger the better, nulls last; ``record_id``, larger first, settles ties. ``roles`` maps the name
    of an output column to the condition under which a record may serve in it (e.g. that the field has a value); -1 where none does.

    A record belongs to one of 2**len(roles) classes by the roles it can serve in, and in each class only the best of a group can be wanted. These are found in
    an aggregation whose partial results shrink a hot group to one row per task before the only shuffle, where each record travels at most once; then single
    records drop out and a window ranks what is left of each group, one record per class, in the same partitions.
    """
    have = sum([F.when(F.coalesce(cond, F.lit(False)), 1 << i).otherwise(0) for i, cond in enumerate(roles.values())], F.lit(0))
    best = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], F.col(record_id).alias("id"))
    classes = range(1 << len(roles))
    g = records.select(*group, have.alias("__have"), best.alias("__best")).groupBy(*group).agg(F.count("*").alias("__n"), *[F.max(F.when(F.col("__have") == c, F.col("__best"))).alias(f"__{c}") for c in classes]).where("__n > 1")
    left = F.array_compact(F.array(*[F.when(F.col(f"__{c}").isNotNull(), F.struct(F.lit(c).alias("have"), F.col(f"__{c}").alias("best"))) for c in classes]))
    w = Window.partitionBy(*group).orderBy(F.desc("__r.best"))
    ranked = g.select(*group, F.explode(left).alias("__r")).select(*group, F.row_number().over(w).alias("__k"), F.col("__r.have").alias("__have"), F.col("__r.best.id").alias("__id"))
    first = lambda i: F.min_by("__id", F.when(F.col("__have").bitwiseAND(F.lit(1 << i)) != 0, F.col("__k")))
    return ranked.groupBy(*group).agg(F.min_by("__id", "__k").alias(record_id), *[F.coalesce(first(i), F.lit(-1)).alias(r) for i, r in enumerate(roles)])


def ranked_observations(ball_raw: DataFrame) -> DataFrame:
    """ball_raw with phase and frame read, the ranking columns, and whether source and confidence have a value.

    phase is compared in lower case without blanks; a record whose phase isn't primary or secondary, whose match is null or whose frame isn't a number is
    left out. NaN is no value. Columns beyond those named are dropped, so they can't clash.
    """
    phase = F.lower(F.trim(F.regexp_replace("phase", r"\s+", " ")))
    seen = lenient_int(F.col("visibility"))
    has = {"x": F.col("x").isNotNull(), "y": F.col("y").isNotNull(), "source": F.coalesce(F.trim(F.regexp_replace("source", r"\s+", " ")) != "", F.lit(False)), "confidence": F.col("confidence").isNotNull() & ~F.isnan("confidence")}
    r = ball_raw.select(
        "match_id", phase.alias("phase"), lenient_int(F.col("frame")).alias("frame"), "row_id", "exported_at", F.when(seen == 1, 2).when(seen == 0, 1).otherwise(0).alias("seen"),
        sum([F.coalesce(h, F.lit(False)).cast("int") for h in list(has.values())[1:]], has["x"].cast("int")).alias("filled"), F.coalesce(has["source"], F.lit(False)).alias("has_source"), F.coalesce(has["confidence"], F.lit(False)).alias("has_confidence"),
        "x", "y", F.trim("source").alias("source"), "confidence",
    )
    return r.where("match_id is not null and frame is not null and phase in ('primary', 'secondary')")


def best_observations(ball_raw: DataFrame) -> DataFrame:
    """Per match, phase and frame with several records: match_id, phase, frame, row_id, source_row_id, confidence_row_id.

    Records rank by visibility (1, 0, else), number of x, y, source, confidence that have a value, later exported_at (null last), larger row_id.
    An empty table gives an empty result.
    """
    # narrow rows for the shuffle: a flag for the phase, visibility and completeness in one byte
    r = ranked_observations(ball_raw).withColumns({"second": F.col("phase") == "secondary", "rank": (F.col("seen") * 8 + F.col("filled")).cast("byte")})
    found = survivors(r, ["match_id", "second", "frame"], [F.col("rank"), F.col("exported_at")], {"source_row_id": F.col("has_source"), "confidence_row_id": F.col("has_confidence")}, "row_id")
    return found.select("match_id", F.when(F.col("second"), "secondary").otherwise("primary").alias("phase"), "frame", "row_id", "source_row_id", "confidence_row_id")


def merged_observations(ball_raw: DataFrame) -> DataFrame:
    """The surviving record itself for every match, phase and frame, groups of one included: visibility of the first record, x, y, source
    and confidence each of the first that has it. One aggregation with map-side partial results; the largest rank wins."""
    r = ranked_observations(ball_raw)
    rank = F.struct("seen", "filled", F.coalesce(F.col("exported_at").isNotNull(), F.lit(False)).alias("dated"), "exported_at", "row_id")
    first = lambda c, when: F.max_by(c, F.when(when, rank)).alias(c)
    return r.groupBy("match_id", "phase", "frame").agg(F.count("*").alias("records"), first("row_id", F.lit(True)), first("seen", F.lit(True)), first("x", F.col("x").isNotNull()), first("y", F.col("y").isNotNull()), first("source", F.col("has_source")), first("confidence", F.col("has_confidence")))
