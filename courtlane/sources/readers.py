"""Sources and sinks: lenient CSV scans, observation parsing, densifying, CSV / JSON writers, and parsing of parameter strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def lenient_long(text: Column) -> Column:
    """int(float(s)) of a text, null where it is no finite number."""
    v = F.when(text.rlike(_NUMERIC), F.trim(text).try_cast("double"))
    return F.when(F.abs(v) < F.lit(2.0**62), v.cast("long"))


def read_ball_csv(spark: SparkSession, path: str) -> DataFrame:
    """Frame, Visibility, X, Y of a detector CSV with a header; unreadable rows are dropped, of rows of one frame the last in the file stays."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    num = raw.select(*[lenient_long(F.col(c)).alias(c.lower()) for c in ("Frame", "Visibility", "X", "Y")], F.monotonically_increasing_id().alias("__at")).dropna()
    return num.groupBy("frame").agg(F.max_by(F.struct("visibility", "x", "y"), "__at").alias("r")).select("frame", "r.visibility", "r.x", "r.y")


def parse_ball_raw(raw: DataFrame) -> DataFrame:
    """Observations from CSV text columns: match_id, phase, frame, vis, x, y, source, conf; of rows of one frame the last (largest row_id) stays.

    Visible means visibility, x and y above zero; the confidence is clipped to 0..1, 1 where none is given, 0 where nothing is visible.
    """
    r = raw.select("match_id", F.lower(F.trim("phase")).alias("phase"), lenient_long(F.col("frame")).alias("frame"), F.struct(lenient_long(F.col("visibility")).alias("v"), "x", "y", F.trim("source").alias("source"), F.col("confidence").alias("c")).alias("r"), "row_id")
    last = r.where("match_id is not null and frame is not null and phase in ('primary', 'secondary')").groupBy("match_id", "phase", "frame").agg(F.max_by("r", "row_id").alias("r"))
    vis = F.coalesce((F.col("r.v") > 0) & (F.col("r.x") > 0) & (F.col("r.y") > 0), F.lit(False))
    return last.withColumn("vis", vis).select(
        "match_id", "phase", "frame", "vis", F.when(F.col("vis"), F.col("r.x").cast("double")).alias("x"), F.when(F.col("vis"), F.col("r.y").cast("double")).alias("y"),
        F.coalesce(F.when(F.col("r.source") != "", F.col("r.source")), F.lit("missing")).alias("source"), F.when(F.col("vis"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("r.c", F.lit(1.0))))).otherwise(0.0).alias("conf"),
    )


def canonical(raw: DataFrame) -> DataFrame:
    """Per match, phase and frame the record that is visible, else the first that came (smallest row_id): match_id, phase, frame, visibility, x, y."""
    r = raw.select("match_id", F.lower(F.trim("phase")).alias("phase"), lenient_long(F.col("frame")).alias("frame"), F.coalesce(lenient_long(F.col("visibility")), F.lit(0)).alias("v"), "x", "y", "row_id").where("match_id is not null and frame is not null and phase in ('primary', 'secondary')")
    seen = F.when((F.col("v") > 0) & (F.col("x") > 0) & (F.col("y") > 0), 1).otherwise(0)
    best = r.groupBy("match_id", "phase", "frame").agg(F.min_by(F.struct(seen.alias("visibility"), F.when(seen == 1, F.col("x")).otherwise(0).alias("x"), F.when(seen == 1, F.col("y")).otherwise(0).alias("y")), F.struct((1 - seen).alias("late"), "row_id")).alias("r"))
    return best.select("match_id", "phase", "frame", F.col("r.visibility").cast("long").alias("visibility"), F.col("r.x").cast("long").alias("x"), F.col("r.y").cast("long").alias("y"))


def densified(series: DataFrame, keys: list[str], fill: dict[str, object]) -> DataFrame:
    """One row for every frame from 0 to the last of each series; missing frames get ``fill``.

    Each row brings the frames up to the next one, so a long series isn't spread out by one task: it takes blocks of frames, joined to their rows.
    """
    last = series.groupBy(*keys).agg(F.max("frame").alias("__last")).where("__last >= 0")
    block = last.select(*keys, "__last", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("__last div 4096"))).alias("__b"))
    spine = block.select(*keys, F.explode(F.expr("sequence(__b * 4096, least(__b * 4096 + 4095, __last))")).alias("frame"))
    out = spine.join(series, [*keys, "frame"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})


def coco_json(truth: DataFrame, width: Column, height: Column, box: int = 10) -> DataFrame:
    """Ground truth as COCO rows: match_id, frame, image and annotation as JSON texts; an annotation is a box of ``box`` px around the ball, null where it isn't visible."""
    image = F.to_json(F.struct(F.col("frame").alias("id"), F.format_string("%06d.png", "frame").alias("file_name"), width.cast("long").alias("width"), height.cast("long").alias("height")))
    corner = lambda c: (F.col(c) - box / 2).cast("long")
    ann = F.to_json(F.struct(F.col("frame").alias("id"), F.col("frame").alias("image_id"), F.lit(1).alias("category_id"), F.array(corner("x"), corner("y"), F.lit(box).cast("long"), F.lit(box).cast("long")).alias("bbox"), F.lit(box * box).alias("area"), F.lit(0).alias("iscrowd")))
    return truth.select("match_id", "frame", image.alias("image"), F.when(F.col("vis"), ann).alias("annotation"))


SIDECAR_DECIMALS = {"hitscore": 4, "confidence": 4, "shotavgspeedkmh": 3}


def sidecar_rows(track: DataFrame, hits: DataFrame) -> DataFrame:
    """The interchange table: the track with the hits of its frames left-joined; an offscreen bridge is a drawing, so its raw fields, hit, track id and rally are blank."""
    h = hits.groupBy("match_id", "frame").agg(F.max_by(F.struct("score", "source", "hitter", "track_id"), F.struct(F.col("score"), F.col("hit_id"))).alias("h"))
    j = track.drop("hit", "hitscore", "hitsource", "hitter").join(h, ["match_id", "frame"], "left")
    drawn = F.col("source") == "offscreen_bridge"
    keep = lambda c, blank=None: F.when(drawn, F.lit(blank)).otherwise(F.col(c))
    return j.select(
        "match_id", "frame", F.col("vis").cast("long").alias("visibility"), "x", "y", "source", "conf", keep("raw_x").alias("raw_x"), keep("raw_y").alias("raw_y"), keep("raw_source", "missing").alias("raw_source"),
        F.when(drawn | F.col("h").isNull(), F.lit(0)).otherwise(1).cast("long").alias("hit"), keep("h.score").alias("hit_score"), keep("h.source").alias("hit_source"), keep("h.hitter").alias("hit_hitter"), keep("h.track_id").cast("long").alias("track_id"), keep("rally", 0).cast("long").alias("rally"),
    )


def write_csv(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """CSV sink with a header; the named columns get fixed decimals, nulls become empty fields."""
    shown = df.withColumns({c: F.format_string(f"%.{n}f", c) for c, n in (decimals or {}).items() if c in df.columns})
    shown.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def rally_manifest(segments: DataFrame, *by: str) -> DataFrame:
    """One JSON manifest per match (and ``by``, e.g. its cutting run): its segments by index."""
    body = F.array_sort(F.collect_list(F.struct("segment_index", "rally_id", "start_frame", "end_frame", "hit_count", "quality")))
    return segments.groupBy("match_id", *by).agg(F.to_json(F.struct(F.count("*").alias("count"), body.alias("segments"))).alias("manifest"), F.count("*").alias("segments"))


def court_points(text: Column) -> Column:
    """Eight numbers from "x1,y1,..,y4", null unless there are exactly eight."""
    parts = F.transform(F.split(text, ","), lambda p: F.when(p.rlike(_NUMERIC), F.trim(p).try_cast("double")))
    return F.when((F.size(parts) == 8) & ~F.exists(parts, lambda p: p.isNull()), parts)


def time_frames(text: Column, fps: Column) -> Column:
    """Frames of a list of seconds ("1.5,3"), sorted, each once; what is no number is left out."""
    parts = F.transform(F.split(text, ","), lambda p: F.when(p.rlike(_NUMERIC), F.trim(p).try_cast("double")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda p: p.isNotNull() & (p >= 0)), lambda p: F.floor(p * fps + 0.5).cast("long"))))


def last_per_frame(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key by ``order``; Spark prunes such a window in every task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
