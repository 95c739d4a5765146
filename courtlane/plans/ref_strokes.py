"""Reference queries: labels, stroke types, gates and sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtlane.functions import geometry as G
from courtlane.functions import strokes as S
from courtlane.plans.views import Registry, hits, info, logits, poses, r6, r6_sql, table, track, with_info

add = Registry()

_SM = "sm AS (SELECT event, truth, list_transform(logits, lambda v: exp(v - list_max(logits))) AS e FROM logits), pr AS (SELECT event, truth, list_transform(e, lambda v: v / list_sum(e)) AS p FROM sm), ex AS (SELECT event, truth, unnest(p) AS p, unnest(range(18)) AS c FROM pr)"
_LAB = "lb AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in S.CLASSES_18) + "]) AS raw_label, unnest(range(18)) AS c)"


@add("logits", _SM, "SELECT event, CAST(c AS BIGINT) AS class_id, round(p, 6) AS probability FROM ex")
def b28_softmax(spark, sf):
    return logits(spark, sf).select("event", F.posexplode(S.softmax(F.col("logits"))).alias("class_id", "p")).select("event", F.col("class_id").cast("long").alias("class_id"), F.round("p", 6).alias("probability"))


_TOP = f"{_SM}, {_LAB}, rk AS (SELECT event, truth, c, raw_label, p, row_number() OVER (PARTITION BY event ORDER BY p DESC, c) AS r FROM ex JOIN lb USING (c))"


@add("logits", _TOP, "SELECT event, CAST(r AS BIGINT) AS rank, CAST(c AS BIGINT) AS class_id, raw_label, CASE WHEN raw_label LIKE 'Top%' THEN 'far' ELSE 'near' END AS model_side, regexp_replace(raw_label, '^(Top|Bottom)[_-]', '') AS label, round(p, 6) AS probability FROM rk WHERE r <= 3")
def g01_top_classes(spark, sf):
    """With H3: the three likeliest classes of an event."""
    t = logits(spark, sf).select("event", F.posexplode(S.top_classes(F.col("logits"))).alias("r", "t"))
    return t.select("event", (F.col("r") + 1).cast("long").alias("rank"), F.col("t.class_id").cast("long").alias("class_id"), "t.raw_label", S.side_of(F.col("t.raw_label")).alias("model_side"), S.without_side(F.col("t.raw_label")).alias("label"), F.round("t.probability", 6).alias("probability"))


_CARD = f"{_TOP}, cd AS (SELECT event, max(p) FILTER (r = 1) AS p1, max(p) FILTER (r = 2) AS p2 FROM rk GROUP BY event), ct AS (SELECT event, p1, p1 - p2 AS margin, event % 4 <> 0 AS confirmed, (event % 101) / 100 AS pose, (event % 67) / 66 AS ball FROM cd)"


@add("logits", _CARD, """SELECT event, round(p1, 6) AS top1, round(margin, 6) AS margin, CASE WHEN p1 < 0.6 THEN 'low_confidence' WHEN NOT confirmed THEN 'event_unconfirmed' WHEN pose < 0.08 THEN 'low_pose_coverage' WHEN ball < 0.08 THEN 'low_ball_coverage' ELSE 'ready' END AS type_reason,
 CASE WHEN p1 < 0.85 THEN 'low_confidence' WHEN margin IS NULL THEN 'margin_unavailable' WHEN margin < 0.25 THEN 'low_margin' WHEN NOT confirmed THEN 'event_unconfirmed' WHEN pose < 0.85 THEN 'low_pose_coverage' WHEN ball < 0.55 THEN 'low_ball_coverage' ELSE 'ready' END AS coach_reason FROM ct""")
def c24_stroke_gates(spark, sf):
    """With K12: the margin of the two likeliest classes. Coverages are made from the event number."""
    t = logits(spark, sf).withColumn("t", S.top_classes(F.col("logits")))
    top1, margin = F.col("t")[0]["probability"], F.col("t")[0]["probability"] - F.col("t")[1]["probability"]
    ok, pose, ball = F.col("event") % 4 != 0, (F.col("event") % 101) / 100, (F.col("event") % 67) / 66
    return t.select("event", F.round(top1, 6).alias("top1"), F.round(margin, 6).alias("margin"), S.type_gate(top1, ok, pose, ball).alias("type_reason"), S.coach_gate(top1, margin, ok, pose, ball).alias("coach_reason"))


_FAMS = " ".join(f"WHEN bare IN ({', '.join(repr(n) for n in ns)}) THEN '{f}'" for f, ns in S.FAMILIES.items())
_LABELS = (*S.CLASSES_18, *[f"Top_{c}" for c in S.CLASSES_12], *[f"Bottom_{c}" for c in S.CLASSES_17], " Smash ", "Bottom_未知", "")
_ALL = ", ".join(f"('{c}')" for c in _LABELS)
_AREA = " ".join(f"WHEN family IN ({', '.join(repr(n) for n in ns)}) THEN '{a}'" for a, ns in S.AREAS.items())


@add("", f"l(raw) AS (VALUES {_ALL}), b AS (SELECT raw, lower(regexp_replace(trim(raw), '^(Top|Bottom)[_-]', '')) AS bare FROM l), f AS (SELECT raw, lower(trim(raw)) AS normal, CASE {_FAMS} END AS family FROM b)", f"SELECT raw, normal, family, CASE WHEN raw LIKE 'Top%' THEN 'far' WHEN raw LIKE 'Bottom%' THEN 'near' END AS side, CASE {_AREA} ELSE 'unknown' END AS area FROM f")
def h02_label_families(spark, sf):
    """With H1, H3 and K17: the label sets and what they mean."""
    l = spark.createDataFrame([(c,) for c in _LABELS], "raw string")
    fam = S.family_of(F.col("raw"))
    return l.select("raw", S.normalised(F.col("raw")).alias("normal"), fam.alias("family"), S.side_of(F.col("raw")).alias("side"), S.area_of(fam).alias("area"))


@add("", "", "SELECT doc_id, regexp_replace(text, '(/[A-Za-z0-9_.-]+){2,}', '[path]', 'g') AS shown FROM documents WHERE text IS NOT NULL")
def h04_path_redaction(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", S.redacted(F.col("text")).alias("shown"))


@add("hits", "", "SELECT hit_id, round(least(1, greatest(0, CASE WHEN s > 1 THEN s / 100 ELSE s END)), 6) AS probability FROM (SELECT hit_id, CASE WHEN hit_id % 2 = 0 THEN score * 100 ELSE score END AS s FROM hits)")
def h05_probability(spark, sf):
    s = F.when(F.col("hit_id") % 2 == 0, F.col("score") * 100).otherwise(F.col("score"))
    return hits(spark, sf).select("hit_id", F.round(S.probability(s), 6).alias("probability"))


_, _YM = G.project("x", "y")
_XM = G.project("x", "y")[0]
_STROKE = f"""st0 AS (SELECT h.*, {_XM} AS mx, {_YM} AS my FROM hits h JOIN info USING (match_id) WHERE rally > 0),
st1 AS (SELECT *, {G.zone(f'abs(my - {G.COURT_L / 2})')} AS origin, row_number() OVER w AS idx, lead(mx) OVER w AS nx, lead(hitter) OVER w AS next_hitter FROM st0 WINDOW w AS (PARTITION BY match_id, rally ORDER BY frame, hit_id)),
st AS (SELECT *, lead(origin) OVER (PARTITION BY match_id, rally ORDER BY frame, hit_id) AS receiver, coalesce(abs(nx - mx), 0) AS lat_m, 3 + hit_id % 8 AS points, (hit_id % 30) / 1e2 AS arc, (hit_id % 17) / 1e1 AS flight, (hit_id % 101) / 1e2 AS pct, hit_id % 3 <> 0 AS reliable, hit_id % 2 = 0 AS high, coalesce(score >= 0.55, false) AS candidate, coalesce(NOT uncertain AND score >= 0.6, false) AS confirmed FROM st1)"""


def _strokes(spark, sf):
    """Hits as strokes: zones and lateral distance from the court positions, the rest made from hit_id; the receiver's side is inferred where the next hit's hitter is unknown."""
    h = with_info(hits(spark, sf).where("rally > 0"), spark, sf).withColumns({"mx": F.expr(_XM), "my": F.expr(_YM)})
    w = Window.partitionBy("match_id", "rally").orderBy("frame", "hit_id")
    h = h.withColumn("origin", F.expr(G.zone(f"abs(my - {G.COURT_L / 2})"))).withColumns({"idx": F.row_number().over(w), "nx": F.lead("mx").over(w), "next_hitter": F.lead("hitter").over(w), "receiver": F.lead("origin").over(w)})
    n = F.col("hit_id")
    return h.withColumns({"lateral": F.coalesce(F.abs(F.col("nx") - F.col("mx")), F.lit(0.0)), "points": 3 + n % 8, "arc": (n % 30) / 100, "flight": (n % 17) / 10, "pct": (n % 101) / 100, "reliable": n % 3 != 0, "high": n % 2 == 0, "candidate": F.coalesce(F.col("score") >= 0.55, F.lit(False)), "confirmed": F.coalesce(~F.col("uncertain") & (F.col("score") >= 0.6), F.lit(False))})


_FAM = """fam AS (SELECT *, CASE WHEN NOT candidate OR points < 4 THEN 'unknown' WHEN idx = 1 THEN 'serve'
 WHEN origin = 'front' THEN CASE receiver WHEN 'back' THEN CASE WHEN arc >= 0.12 OR flight >= 1.1 THEN 'lift' ELSE 'push' END WHEN 'front' THEN CASE WHEN lat_m >= 1.15 THEN 'cross_net' ELSE 'net' END WHEN 'mid' THEN CASE WHEN reliable AND high AND pct >= 0.82 THEN 'net_kill' ELSE 'push' END ELSE 'front_unknown' END
 WHEN origin = 'back' THEN CASE receiver WHEN 'front' THEN CASE WHEN reliable AND high AND pct >= 0.85 THEN 'smash' ELSE 'drop' END WHEN 'back' THEN CASE WHEN arc >= 0.14 AND flight >= 1.1 THEN 'clear' WHEN arc < 0.14 THEN 'drive_clear' ELSE 'back_unknown' END WHEN 'mid' THEN CASE WHEN reliable AND high AND pct >= 0.85 THEN 'smash' WHEN arc < 0.12 THEN 'defensive_drive' ELSE 'drive_clear' END ELSE 'back_unknown' END ELSE 'unknown' END AS family FROM st),
sc AS (SELECT *, least(88, 22 + CASE WHEN confirmed THEN 20 ELSE 0 END + CASE WHEN points >= 4 THEN 17 ELSE 0 END + CASE WHEN reliable THEN 10 ELSE 0 END + CASE WHEN origin IS NOT NULL THEN 13 ELSE 0 END + CASE WHEN receiver IS NOT NULL THEN 13 ELSE 0 END + CASE WHEN hit_id % 5 >= 2 AND pct >= 0.45 THEN 8 ELSE 0 END) AS raw FROM fam),
se AS (SELECT *, round_even(greatest(20, raw - CASE WHEN hitter_source = 'rally_inference' THEN 12 ELSE 0 END - CASE WHEN receiver IS NOT NULL AND next_hitter = 'unknown' THEN 8 ELSE 0 END), 0) AS score0 FROM sc),
fc AS (SELECT *, CASE WHEN candidate AND NOT confirmed OR family IN ('unknown', 'front_unknown', 'back_unknown') THEN 58 ELSE 100 END AS c1, CASE WHEN family IN ('cross_net', 'net', 'defensive_drive') THEN 74 ELSE 100 END AS c2, CASE WHEN NOT reliable AND family IN ('smash', 'net_kill', 'drive_clear') THEN 65 ELSE 100 END AS c3 FROM se)"""


def _classified(spark, sf):
    s = _strokes(spark, sf)
    fast = {q: F.col("reliable") & F.col("high") & (F.col("pct") >= q) for q in (0.82, 0.85)}
    fam = S.route_family(F.col("origin"), F.col("receiver"), F.col("arc"), F.col("flight"), fast, F.col("lateral"), F.col("idx") == 1, F.col("points"), F.col("candidate"))
    s = s.withColumn("family", fam)
    raw = S.evidence_score(F.col("confirmed"), F.col("points"), F.col("reliable"), F.col("origin"), F.col("receiver"), F.col("hit_id") % 5, F.col("pct"), F.coalesce(F.col("hitter_source") == "rally_inference", F.lit(False)), F.col("receiver").isNotNull() & (F.col("next_hitter") == "unknown"))
    return s.withColumn("confidence", S.capped_confidence(raw, F.col("family"), F.col("candidate"), F.col("confirmed"), F.col("reliable")))


@add("hits info", _STROKE + ", " + _FAM, "SELECT hit_id, family, CAST(least(least(score0, c1), least(c2, c3)) AS DOUBLE) AS confidence, CASE WHEN least(least(score0, c1), least(c2, c3)) >= 72 THEN 'medium' ELSE 'low' END AS level FROM fc")
def h06_stroke_family(spark, sf):
    """With H7, H7b and K13."""
    return _classified(spark, sf).select("hit_id", "family", "confidence", S.confidence_level(F.col("confidence")).alias("level"))


@add("hits info", _STROKE, "SELECT hit_id, CASE WHEN points % 2 = 0 AND abs(arc * 10 - 1.5) >= 0.25 AND reliable THEN CASE WHEN arc * 10 - 1.5 > 0 THEN 'forehand' ELSE 'backhand' END END AS variant FROM st")
def h08_hand_variant(spark, sf):
    """A right-handed player; arm and side of the contact are made from hit_id."""
    arm = F.when(F.col("points") % 2 == 0, "right").otherwise("left")
    return _strokes(spark, sf).select("hit_id", S.hand_variant(F.lit("right"), arm, F.col("arc") * 10 - 1.5, F.col("reliable")).alias("variant"))


_REV = _STROKE + ", " + _FAM + """, rv AS (SELECT match_id, rally, idx, frame, family, least(least(score0, c1), least(c2, c3)) AS conf FROM fc WHERE candidate),
amb AS (SELECT match_id, rally, idx FROM rv JOIN (SELECT match_id, frame FROM rv GROUP BY ALL HAVING count(DISTINCT (rally, idx)) > 1) USING (match_id, frame)),
one AS (SELECT match_id, rally, idx, min(frame) AS frame, max(family) AS family, min(conf) AS conf FROM rv WHERE (match_id, rally, idx) NOT IN (SELECT (match_id, rally, idx) FROM amb) GROUP BY ALL HAVING count(DISTINCT family) = 1)"""


def _reviews(spark, sf):
    """One review per (rally, hit): frames claimed by several are left out with all they touch, and so is an identity with several families."""
    rv = _classified(spark, sf).where("candidate").select("match_id", "rally", "idx", "frame", "family", F.col("confidence").alias("conf"))
    twice = rv.groupBy("match_id", "frame").agg(F.count_distinct("rally", "idx").alias("n")).where("n > 1").select("match_id", "frame")
    amb = rv.join(twice, ["match_id", "frame"], "left_semi").select("match_id", "rally", "idx").distinct()
    return rv.join(amb, ["match_id", "rally", "idx"], "left_anti").groupBy("match_id", "rally", "idx").agg(F.min("frame").alias("frame"), F.max("family").alias("family"), F.min("conf").alias("conf"), F.count_distinct("family").alias("n")).where("n = 1").drop("n")


@add("hits info", _REV, "SELECT match_id, family, CAST(count(*) AS BIGINT) AS hits, round(avg(conf), 6) AS average_confidence, count(*) >= 3 AS advised FROM one GROUP BY match_id, family")
def e15_review_summary(spark, sf):
    """With C26: three independent hits make a family worth advice."""
    return _reviews(spark, sf).groupBy("match_id", "family").agg(F.count("*").alias("hits"), F.round(F.avg("conf"), 6).alias("average_confidence"), (F.count("*") >= 3).alias("advised"))


@add("hits info", _REV + ", g AS (SELECT match_id, family, count(*) AS n FROM one GROUP BY ALL)", "SELECT match_id, family, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY match_id ORDER BY n DESC, family) AS BIGINT) AS place FROM g QUALIFY place <= 3")
def g08_ranked_families(spark, sf):
    """With G3: the three commonest families of a match, ties by name."""
    g = _reviews(spark, sf).groupBy("match_id", "family").agg(F.count("*").alias("n"))
    w = Window.partitionBy("match_id").orderBy(F.desc("n"), "family")
    return g.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3")


@add("hits info", _REV, "SELECT match_id, rally, idx, family FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY r > 1, frame, rally, idx) AS k FROM (SELECT *, row_number() OVER (PARTITION BY match_id, family ORDER BY frame, rally, idx) AS r FROM one)) WHERE k <= 12")
def g05_diverse_representatives(spark, sf):
    """The first review of each family, then others by time, twelve in all: a top-k report."""
    a = Window.partitionBy("match_id", "family").orderBy("frame", "rally", "idx")
    b = Window.partitionBy("match_id").orderBy(F.col("r") > 1, "frame", "rally", "idx")
    return _reviews(spark, sf).withColumn("r", F.row_number().over(a)).withColumn("k", F.row_number().over(b)).where("k <= 12").select("match_id", "rally", F.col("idx").cast("long").alias("idx"), "family")


@add("hits", "n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame, hit_id) - 1 AS i, count(*) OVER (PARTITION BY match_id) AS c FROM hits), w AS (SELECT DISTINCT match_id, CAST(floor(k * c / 36) AS BIGINT) AS i FROM (SELECT DISTINCT match_id, c FROM n), (SELECT unnest(range(36)) AS k))", "SELECT n.match_id, hit_id FROM n JOIN w ON w.match_id = n.match_id AND w.i = n.i")
def g04_even_sample(spark, sf):
    """36 hits of a match at an even stride: a sampling operator. The window runs over the hits of a match."""
    w = Window.partitionBy("match_id").orderBy("frame", "hit_id")
    h = hits(spark, sf).select("match_id", "hit_id", "frame").withColumn("i", F.row_number().over(w) - 1)
    n = h.groupBy("match_id").agg(F.count("*").alias("c"))
    want = n.select("match_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(35)), lambda k: F.floor(k * F.col("c") / 36)))).alias("i"))
    return h.join(want, ["match_id", "i"]).select("match_id", "hit_id")


_SEQ = "sq AS (SELECT h.hit_id, h.match_id, h.frame + o AS frame, o FROM hits h, (SELECT unnest(range(-40, 41, 4)) AS o))"


@add("track hits", _SEQ, "SELECT s.hit_id, CAST(count(*) AS BIGINT) AS steps, CAST(count(t.x) AS BIGINT) AS ball_steps, round(count(t.x) / 21, 6) AS ball_coverage, round(coalesce(avg(t.x), 0), 6) AS mean_x FROM sq s LEFT JOIN (SELECT match_id, frame, x FROM track WHERE vis AND source IN ('model', 'classical')) t USING (match_id, frame) GROUP BY s.hit_id")
def h11_event_sequences(spark, sf):
    """With G6 and D13: 21 samples of the track around each hit, every fourth frame, and what of it the ball covers."""
    s = hits(spark, sf).select("hit_id", "match_id", F.explode(F.sequence(F.col("frame") - 40, F.col("frame") + 40, F.lit(4))).alias("frame"))
    t = track(spark, sf).where(F.col("vis") & F.col("source").isin("model", "classical")).select("match_id", "frame", "x")
    return s.join(t, ["match_id", "frame"], "left").groupBy("hit_id").agg(F.count("*").alias("steps"), F.count("x").alias("ball_steps"), F.round(F.count("x") / 21, 6).alias("ball_coverage"), F.round(F.coalesce(F.avg("x"), F.lit(0.0)), 6).alias("mean_x"))


@add("", "", "SELECT doc_id, json_extract_string(text, '$.court') AS court, CAST(json_extract_string(text, '$.clip') AS BIGINT) AS clip, CAST(json_array_length(text, '$.tags') AS BIGINT) AS tags, CASE WHEN json_extract_string(text, '$.checked') = 'true' THEN true WHEN json_extract_string(text, '$.checked') = 'false' THEN false END AS checked FROM documents WHERE json_valid(text) AND text LIKE '{%'")
def h12_json_manifests(spark, sf):
    """Relayed JSON texts by a schema; a text that is no JSON object is left out."""
    d = table(spark, sf, "documents").where(F.col("text").startswith("{"))
    j = F.from_json("text", "court string, clip long, tags array<string>, checked boolean, _corrupt_record string")
    return d.withColumn("j", j).where("j is not null and j._corrupt_record is null").select("doc_id", "j.court", "j.clip", F.size("j.tags").cast("long").alias("tags"), "j.checked")


@add("track", "m AS (SELECT match_id, frame FROM track WHERE vis AND source = 'model'), k AS (SELECT match_id, frame FROM track WHERE raw_vis AND raw_source IN ('model', 'classical')), h AS (SELECT match_id, frame FROM track WHERE hit)", "(SELECT match_id, frame, 'kept' AS part FROM m INTERSECT SELECT match_id, frame, 'kept' FROM k) UNION ALL (SELECT match_id, frame, 'raw_only' FROM k EXCEPT SELECT match_id, frame, 'raw_only' FROM m) UNION ALL (SELECT match_id, frame, 'any' FROM m UNION SELECT match_id, frame, 'any' FROM h)")
def g07_frame_sets(spark, sf):
    t = track(spark, sf)
    m = t.where("vis and source = 'model'").select("match_id", "frame")
    k = t.where("raw_vis and raw_source in ('model', 'classical')").select("match_id", "frame")
    part = lambda df, name: df.withColumn("part", F.lit(name))
    return part(m.join(k, ["match_id", "frame"], "left_semi"), "kept").unionByName(part(k.join(m, ["match_id", "frame"], "left_anti"), "raw_only")).unionByName(part(m.unionByName(t.where("hit").select("match_id", "frame")).distinct(), "any"))


@add("info", "", "SELECT match_id, CAST(a AS BIGINT) AS x0, CAST(b AS BIGINT) AS y0, CAST(least(a + 512, width) AS BIGINT) AS x1, CAST(least(b + 288, height) AS BIGINT) AS y1 FROM (SELECT match_id, width, height, unnest(range(0, CAST(greatest(1, width - 64) AS BIGINT), 448)) AS a FROM info) x, LATERAL (SELECT unnest(range(0, CAST(greatest(1, height - 32) AS BIGINT), 256)) AS b)")
def g09_tiles(spark, sf):
    """Tiles of 512 x 288 px that overlap by 64 and 32 px: a handful per match."""
    m = info(spark, sf).withColumn("x0", F.explode(F.expr("sequence(0L, cast(greatest(1, width - 64) as bigint) - 1, 448L)"))).withColumn("y0", F.explode(F.expr("sequence(0L, cast(greatest(1, height - 32) as bigint) - 1, 256L)")))
    return m.select("match_id", "x0", "y0", F.least(F.col("x0") + 512, F.col("width")).cast("long").alias("x1"), F.least(F.col("y0") + 288, F.col("height")).cast("long").alias("y1"))


_D10 = f"{_TOP}, cs AS (SELECT event, 1001 + truth AS match_id, event AS frame, CASE WHEN raw_label LIKE 'Top%' THEN 'far' ELSE 'near' END AS mside, regexp_replace(raw_label, '^(Top|Bottom)[_-]', '') AS label, p FROM rk WHERE r = 1)"


@add("logits hits", _D10, "SELECT hit_id, label, round(p, 6) AS probability FROM hits h JOIN cs ON cs.match_id = h.match_id AND abs(cs.frame - h.frame) <= 2 QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY mside = h.hitter DESC, p DESC, cs.event) = 1")
def d10_cards_for_hits(spark, sf):
    """With D11: the best stroke card within two frames of a hit: the same side first, then the likelier."""
    c = logits(spark, sf).withColumn("t", S.top_classes(F.col("logits"), 1)[0])
    c = c.select("event", (F.col("truth") + 1001).alias("match_id"), S.side_of(F.col("t.raw_label")).alias("mside"), S.without_side(F.col("t.raw_label")).alias("label"), F.col("t.probability").alias("p"), F.explode(F.sequence(F.col("event") - 2, F.col("event") + 2)).alias("frame"))
    w = Window.partitionBy("hit_id").orderBy(F.desc(F.col("mside") == F.col("hitter")), F.desc("p"), "event")
    return hits(spark, sf).select("hit_id", "match_id", "frame", "hitter").join(c, ["match_id", "frame"]).withColumn("n", F.row_number().over(w)).where("n = 1").select("hit_id", "label", F.round("p", 6).alias("probability"))


_MFAM = _FAMS.replace("bare", "lower(label)")
_AREAF = lambda c: "CASE " + " ".join(f"WHEN {c} IN ({', '.join(repr(n) for n in ns)}) THEN '{a}'" for a, ns in S.AREAS.items()) + " ELSE 'unknown' END"
_H9 = _STROKE + ", " + _FAM + f""", {_CARD},
c1 AS (SELECT ct.event, p1, margin, confirmed AS ok, pose, ball, raw_label, regexp_replace(raw_label, '^(Top|Bottom)[_-]', '') AS label, CASE WHEN raw_label LIKE 'Top%' THEN 'far' ELSE 'near' END AS mside FROM ct JOIN rk ON rk.event = ct.event AND rk.r = 1),
c2 AS (SELECT *, CASE {_MFAM} END AS model FROM c1),
j AS (SELECT fc.hit_id, fc.family AS rule, fc.hitter, c2.*, c2.event IS NOT NULL AS carded FROM fc LEFT JOIN c2 ON c2.event = fc.hit_id % 500),
a AS (SELECT *, CASE WHEN rule = 'front_unknown' THEN 'front' WHEN rule = 'back_unknown' THEN 'back' ELSE {_AREAF('rule')} END AS rarea, {_AREAF('model')} AS marea FROM j),
st9 AS (SELECT hit_id, rule, model, CASE WHEN NOT carded THEN 'unavailable' WHEN hitter IN ('near', 'far') AND hitter <> mside THEN 'side_mismatch' WHEN p1 < 0.6 THEN 'low_confidence' WHEN NOT ok OR pose < 0.08 OR ball < 0.08 THEN 'insufficient_evidence' WHEN model IS NULL THEN 'unsupported'
 WHEN CASE WHEN rule IN ('unknown', 'front_unknown', 'back_unknown') THEN rarea <> 'unknown' AND rarea <> marea ELSE rule <> model END THEN 'conflict' WHEN rule = model THEN CASE WHEN p1 >= 0.85 AND margin >= 0.25 AND pose >= 0.85 AND ball >= 0.55 THEN 'agreement' ELSE 'rule_fallback' END ELSE 'adopted' END AS status FROM a)"""


@add("hits info logits", _H9, "SELECT hit_id, status, CASE WHEN status IN ('agreement', 'adopted') THEN model ELSE rule END AS family FROM st9")
def h09_type_choice(spark, sf):
    """Cards are dealt to hits by number (hit_id modulo 500), as few lie at the same time."""
    ok, pose, ball = F.col("event") % 4 != 0, (F.col("event") % 101) / 100, (F.col("event") % 67) / 66
    c = logits(spark, sf).withColumn("t", S.top_classes(F.col("logits")))
    c = c.select(F.col("event").alias("card"), F.lit(True).alias("carded"), F.col("t")[0]["probability"].alias("p1"), (F.col("t")[0]["probability"] - F.col("t")[1]["probability"]).alias("gain"), ok.alias("ok"), pose.alias("pose"), ball.alias("ball"), S.family_of(F.col("t")[0]["raw_label"]).alias("model"), S.side_of(F.col("t")[0]["raw_label"]).alias("mside"))
    h = _classified(spark, sf).select("hit_id", "family", "hitter", (F.col("hit_id") % 500).alias("card")).join(c, "card", "left")
    side_ok = ~F.coalesce(F.col("hitter").isin("near", "far") & (F.col("hitter") != F.col("mside")), F.lit(False))
    status, family = S.type_choice(F.col("family"), F.col("model"), F.coalesce("carded", F.lit(False)), side_ok, F.col("p1"), F.col("ok"), F.col("pose"), F.col("ball"), F.col("gain"))
    return h.select("hit_id", status.alias("status"), family.alias("family"))


@add("logits hits", _D10, "SELECT h.hit_id, coalesce(any_value(label), '') AS label FROM hits h LEFT JOIN (SELECT match_id, frame, arg_min(label, event) AS label FROM cs GROUP BY 1, 2) c ON c.match_id = h.match_id AND c.frame = h.frame GROUP BY h.hit_id")
def d11_labels_on_frames(spark, sf):
    """D11: the label on a hit's own frame, the first event's where several stand there, an empty text where none does."""
    c = logits(spark, sf).withColumn("t", S.top_classes(F.col("logits"), 1)[0])
    c = c.groupBy((F.col("truth") + 1001).alias("match_id"), F.col("event").alias("frame")).agg(F.min_by(S.without_side(F.col("t.raw_label")), "event").alias("label"))
    return hits(spark, sf).select("hit_id", "match_id", "frame").join(c, ["match_id", "frame"], "left").select("hit_id", F.coalesce("label", F.lit("")).alias("label"))


@add("logits", "", "SELECT event, CAST(list_position(logits, list_max(logits)) - 1 AS BIGINT) AS class_id FROM logits")
def j01_predictor_hook(spark, sf):
    """J1: a model as a pandas function of feature batches, here the index of the largest score."""
    from courtlane.functions.hooks import predicted

    return predicted(logits(spark, sf), "logits", lambda rows: rows.argmax(axis=1), "event", "class_id")
