"""The canonical series that the reference queries read, as DataFrames and, for the oracle, as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlane.session import join_small, table
from courtlane.sources.readers import parse_ball_raw

#: Source labels by role.
REAL = ("model", "classical")
EDGE = ("model_edge", "single_phase_edge")
DERIVED = ("classical_gap",)
TRACKING = (*REAL, *EDGE, *DERIVED)
MEASURED = (*REAL, "interp")


def quoted(labels: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in labels)


def info(spark: SparkSession, sf: str) -> DataFrame:
    """match_info, one row per match; repeated rows agree in what is used."""
    hs = [f"h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    t = table(spark, sf, "match_info").where("match_id is not null")
    corners = {f"q{k}": F.max(F.col("court_quad")[k]) for k in range(8)}
    return t.groupBy("match_id").agg(F.max("fps").cast("double").alias("fps"), F.max("width").cast("double").alias("width"), F.max("height").cast("double").alias("height"), *[F.max(h).alias(h) for h in hs], *[c.alias(n) for n, c in corners.items()])


def track(spark: SparkSession, sf: str) -> DataFrame:
    """The sidecar as a series: one row per match and frame, x and y null where nothing is visible, labels never null."""
    s = table(spark, sf, "sidecar").where("match_id is not null and frame is not null")
    g = s.groupBy("match_id", F.col("frame").cast("long").alias("frame")).agg(*[F.max(c).alias(c) for c in ("visibility", "x", "y", "source", "confidence", "rawvisibility", "rawx", "rawy", "rawsource", "hit", "hitscore", "hitsource", "hithitter", "rallyid", "shotavgspeedkmh", "shotspeedquality", "shotendframe")])
    vis = F.coalesce((F.col("visibility") == 1) & (F.col("x") > 0) & (F.col("y") > 0), F.lit(False))
    raw = F.coalesce((F.col("rawvisibility") == 1) & (F.col("rawx") > 0) & (F.col("rawy") > 0), F.lit(False))
    return g.select(
        "match_id", "frame", vis.alias("vis"), F.when(vis, F.col("x").cast("double")).alias("x"), F.when(vis, F.col("y").cast("double")).alias("y"), F.coalesce("source", F.lit("missing")).alias("source"),
        F.when(vis, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(1.0))))).otherwise(0.0).alias("conf"), raw.alias("raw_vis"), F.when(raw, F.col("rawx").cast("double")).alias("raw_x"), F.when(raw, F.col("rawy").cast("double")).alias("raw_y"), F.coalesce("rawsource", F.lit("missing")).alias("raw_source"),
        F.coalesce(F.col("hit") == 1, F.lit(False)).alias("hit"), "hitscore", "hitsource", F.lower(F.trim(F.coalesce("hithitter", F.lit("unknown")))).alias("hitter"), F.coalesce("rallyid", F.lit(0)).cast("long").alias("rally"),
        F.col("shotavgspeedkmh").alias("speed"), "shotspeedquality", F.col("shotendframe").cast("long").alias("shot_end"),
    )


def ball(spark: SparkSession, sf: str) -> DataFrame:
    """Detector observations: one per match, phase and frame."""
    return parse_ball_raw(table(spark, sf, "ball_raw"))


def phases(spark: SparkSession, sf: str) -> DataFrame:
    """Both phases side by side: one row per match and frame that either has."""
    b = ball(spark, sf)
    side = lambda phase, p: b.where(F.col("phase") == phase).select("match_id", "frame", *[F.col(c).alias(f"{p}_{c}") for c in ("vis", "x", "y", "source", "conf")])
    both = side("primary", "a").join(side("secondary", "b"), ["match_id", "frame"], "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("a_vis", "b_vis")})


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hit events: one row per hit_id that has a match and a frame."""
    t = table(spark, sf, "hit_event").where("hit_id is not null")
    g = t.groupBy("hit_id").agg(*[F.max(c).alias(c) for c in ("match_id", "frame", "x", "y", "score", "speed", "source", "hitter", "hitter_confidence", "hitter_source", "rally", "track_id", "uncertain")])
    return g.where("match_id is not null and frame is not null").withColumns({"frame": F.col("frame").cast("long"), "rally": F.col("rally").cast("long"), "hitter": F.coalesce("hitter", F.lit("unknown")), "source": F.coalesce("source", F.lit("unknown"))})


def impulses(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "audio_impulse").where("audio_id is not null")
    return t.groupBy("audio_id").agg(F.max("match_id").alias("match_id"), F.max("frame").cast("long").alias("frame"), F.max("score").alias("score")).where("match_id is not null and frame is not null")


def poses(spark: SparkSession, sf: str) -> DataFrame:
    """Pose samples made from the embeddings: 17 keypoints (x, y, conf), frame vec_id of match 1001 + label, sides far and near by turns."""
    e = table(spark, sf, "embeddings")
    v = lambda k: F.col("embedding")[k].cast("double")
    points = F.array(*[F.struct((v(3 * j) * 100 + 300).alias("x"), (v(3 * j + 1) * 100 + 400).alias("y"), F.least(F.lit(1.0), F.abs(v(3 * j + 2)) * 4).alias("conf")) for j in range(17)])
    return e.select((F.col("label") + 1001).cast("long").alias("match_id"), F.col("vec_id").alias("frame"), F.when(F.col("vec_id") % 2 == 0, "far").otherwise("near").alias("side"), points.alias("kp"), *[(F.abs(v(51 + k)) * 100 + 100 + 150 * (k // 2)).alias(f"b{k}") for k in range(4)])


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Class scores made from the embeddings: the first 18 entries times 10."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("event"), F.array(*[F.col("embedding")[k].cast("double") * 10 for k in range(18)]).alias("logits"), F.col("label").cast("long").alias("truth"))


def with_info(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return join_small(df, info(spark, sf), ["match_id"], "inner")


_MAXES = ", ".join(f"max({c}) AS {c}" for c in ("visibility", "x", "y", "source", "confidence", "rawvisibility", "rawx", "rawy", "rawsource", "hit", "hitscore", "hitsource", "hithitter", "rallyid", "shotavgspeedkmh", "shotspeedquality", "shotendframe"))
_NUMBER = "CASE WHEN isfinite(TRY_CAST(trim({0}) AS DOUBLE)) THEN CAST(trunc(TRY_CAST(trim({0}) AS DOUBLE)) AS BIGINT) END"

CTES = {
    "info": "info AS (SELECT match_id, CAST(max(fps) AS DOUBLE) AS fps, CAST(max(width) AS DOUBLE) AS width, CAST(max(height) AS DOUBLE) AS height, " + ", ".join(f"max(h{i}{j}) AS h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + ", " + ", ".join(f"max(court_quad[{k + 1}]) AS q{k}" for k in range(8)) + " FROM match_info WHERE match_id IS NOT NULL GROUP BY match_id)",
    "track": f"""track0 AS (SELECT match_id, CAST(frame AS BIGINT) AS frame, {_MAXES} FROM sidecar WHERE match_id IS NOT NULL AND frame IS NOT NULL GROUP BY match_id, frame),
track1 AS (SELECT *, coalesce(visibility = 1 AND x > 0 AND y > 0, false) AS vis, coalesce(rawvisibility = 1 AND rawx > 0 AND rawy > 0, false) AS raw_vis FROM track0),
track AS (SELECT match_id, frame, vis, CASE WHEN vis THEN CAST(x AS DOUBLE) END AS x, CASE WHEN vis THEN CAST(y AS DOUBLE) END AS y, coalesce(source, 'missing') AS source, CASE WHEN vis THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(confidence, 1.0::DOUBLE))) ELSE 0.0::DOUBLE END AS conf,
  raw_vis, CASE WHEN raw_vis THEN CAST(rawx AS DOUBLE) END AS raw_x, CASE WHEN raw_vis THEN CAST(rawy AS DOUBLE) END AS raw_y, coalesce(rawsource, 'missing') AS raw_source, coalesce(hit = 1, false) AS hit, hitscore, hitsource, lower(trim(coalesce(hithitter, 'unknown'))) AS hitter, CAST(coalesce(rallyid, 0) AS BIGINT) AS rally,
  shotavgspeedkmh AS speed, shotspeedquality, CAST(shotendframe AS BIGINT) AS shot_end FROM track1)""",
    "ball": f"""ball0 AS (SELECT match_id, lower(trim(phase)) AS phase, {_NUMBER.format("frame")} AS frame, {_NUMBER.format("visibility")} AS v, x, y, nullif(trim(source), '') AS source, confidence, row_id FROM ball_raw),
ball1 AS (SELECT match_id, phase, frame, max(row_id) AS row_id, arg_max(struct_pack(v := v, x := x, y := y, source := source, c := confidence), row_id) AS r FROM ball0 WHERE match_id IS NOT NULL AND frame IS NOT NULL AND phase IN ('primary', 'secondary') GROUP BY 1, 2, 3),
ball2 AS (SELECT *, coalesce(r.v > 0 AND r.x > 0 AND r.y > 0, false) AS vis FROM ball1),
ball AS (SELECT match_id, phase, frame, vis, CASE WHEN vis THEN CAST(r.x AS DOUBLE) END AS x, CASE WHEN vis THEN CAST(r.y AS DOUBLE) END AS y, coalesce(r.source, 'missing') AS source, CASE WHEN vis THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(r.c, 1.0::DOUBLE))) ELSE 0.0::DOUBLE END AS conf FROM ball2)""",
    "phases": """phases AS (SELECT match_id, frame, coalesce(a.vis, false) AS a_vis, a.x AS a_x, a.y AS a_y, a.source AS a_source, a.conf AS a_conf, coalesce(b.vis, false) AS b_vis, b.x AS b_x, b.y AS b_y, b.source AS b_source, b.conf AS b_conf
  FROM (SELECT * FROM ball WHERE phase = 'primary') a FULL JOIN (SELECT * FROM ball WHERE phase = 'secondary') b USING (match_id, frame))""",
    "hits": """hits AS (SELECT hit_id, match_id, CAST(frame AS BIGINT) AS frame, x, y, score, speed, coalesce(source, 'unknown') AS source, coalesce(hitter, 'unknown') AS hitter, hitter_confidence, hitter_source, CAST(rally AS BIGINT) AS rally, track_id, uncertain FROM
  (SELECT hit_id, """ + ", ".join(f"max({c}) AS {c}" for c in ("match_id", "frame", "x", "y", "score", "speed", "source", "hitter", "hitter_confidence", "hitter_source", "rally", "track_id", "uncertain")) + """ FROM hit_event WHERE hit_id IS NOT NULL GROUP BY hit_id) WHERE match_id IS NOT NULL AND frame IS NOT NULL)""",
    "impulses": "impulses AS (SELECT * FROM (SELECT audio_id, max(match_id) AS match_id, CAST(max(frame) AS BIGINT) AS frame, max(score) AS score FROM audio_impulse WHERE audio_id IS NOT NULL GROUP BY audio_id) WHERE match_id IS NOT NULL AND frame IS NOT NULL)",
    "poses": "poses AS (SELECT CAST(label + 1001 AS BIGINT) AS match_id, vec_id AS frame, CASE WHEN vec_id % 2 = 0 THEN 'far' ELSE 'near' END AS side, list_transform(range(17), lambda j: struct_pack(x := CAST(embedding[3 * j + 1] AS DOUBLE) * 100 + 300, y := CAST(embedding[3 * j + 2] AS DOUBLE) * 100 + 400, conf := least(1.0::DOUBLE, abs(CAST(embedding[3 * j + 3] AS DOUBLE)) * 4))) AS kp, " + ", ".join(f"abs(CAST(embedding[{52 + k}] AS DOUBLE)) * 100 + {100 + 150 * (k // 2)} AS b{k}" for k in range(4)) + " FROM embeddings)",
    "logits": "logits AS (SELECT vec_id AS event, list_transform(range(18), lambda k: CAST(embedding[k + 1] AS DOUBLE) * 10) AS logits, CAST(label AS BIGINT) AS truth FROM embeddings)",
}
_NEEDS = {"phases": ["ball"]}


def with_ctes(views: str, ctes: str, final: str) -> str:
    """A statement over the named views, further common table expressions, and the final SELECT."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    parts = [CTES[n] for n in names] + ([ctes] if ctes.strip() else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


class Registry:
    """Queries and their oracle statements, filled by the decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, views: str = "", ctes: str = "", final: str = ""):
        def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[f.__name__] = f
            if final:
                self.sql[f.__name__] = with_ctes(views, ctes, final)
            return f

        return add


def r6(*cols: str) -> list:
    """Columns rounded to 6 decimals, as engines sum in different orders."""
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def r6_sql(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)
