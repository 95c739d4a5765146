"""The operators of the llm subpackage on small fixtures: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import random
import unicodedata
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from courtlane.llm import bpe, leaks, nearest, quantiles, survivors, truncation

# --- best representative -------------------------------------------------------------------------------------------

RAW = "row_id long, match_id long, phase string, frame string, visibility string, x int, y int, source string, confidence double, exporter string, exported_at timestamp"


def raw(i, frame="7", phase="primary", v="1", x=1, y=1, s="model", c=0.5, at=1):
    return (i, 1, phase, frame, v, x, y, s, c, None, datetime(2026, 1, at) if at else None)


def test_survivors(spark):
    rows = [
        raw(1, v="0", s="classical"), raw(2, " 7.9 ", "PRIMARY ", x=None, s=" ", c=None), raw(3, "+7", v="n/a", at=9),  # visible wins although less complete
        raw(4, "8", c=None), raw(5, "8", c=None), raw(6, "8", s=None, c=0.0, at=None),  # ties: later, then larger row_id
        raw(7, "9"), raw(8, "nan"), raw(9, None), raw(10, "frame"), raw(11, "1e1", s="", c=None), raw(12, "10", s=None, c=float("nan")), raw(13, "7d"),
    ]
    df = spark.createDataFrame(rows, RAW).withColumns({c: F.lit(1) for c in ("__role", "__n", "seen", "filled")})
    got = sorted(tuple(r) for r in survivors.best_observations(df).collect())
    assert got == [(1, "primary", 7, 2, 1, 1), (1, "primary", 8, 5, 5, 6), (1, "primary", 10, 12, -1, -1)]
    assert survivors.best_observations(df.limit(0)).count() == 0


def test_merged_observations_cover_single_records(spark):
    df = spark.createDataFrame([raw(1, v="0", s="classical"), raw(2, s=" ", c=None), raw(3, "9")], RAW)
    got = {r.frame: (r.row_id, r.source, r.confidence, r.records) for r in survivors.merged_observations(df).collect()}
    assert got == {7: (2, "classical", 0.5, 2), 9: (3, "model", 0.5, 1)}


def test_merged_fields_come_from_the_best_record_that_has_them(spark):
    df = spark.createDataFrame([raw(1, v="0", x=3, y=4), raw(2, x=None, y=9), raw(3, v="0", x=5, y=6, at=2), raw(4, "8", x=None, y=None)], RAW)
    got = {r.frame: (r.row_id, r.x, r.y) for r in survivors.merged_observations(df).collect()}
    assert got == {7: (2, 5, 9), 8: (4, None, None)}


def test_survivors_equal_brute_force_and_a_hot_group_is_cut_before_the_shuffle(spark):
    rnd = random.Random(12)
    rows = [(i, rnd.choice([0, 0, 0, rnd.randrange(400)]), rnd.choice([None, 1, 2]), rnd.choice([None, "a"]), rnd.choice([None, 0.5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g long, rank int, a string, b double").withColumns({c: F.lit(1) for c in ("__n", "__k", "__r", "__have", "__best")})
    got = {r.g: (r.id, r.ra, r.rb) for r in survivors.survivors(df, ["g"], [F.col("rank")], {"ra": F.col("a").isNotNull(), "rb": F.col("b").isNotNull()}, "id").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] or 0, r[0]), reverse=True)
        if len(mine) > 1:
            want[g] = (mine[0][0], *(next((r[0] for r in mine if r[k] is not None), -1) for k in (3, 4)))
    assert got == want
    plan = survivors.survivors(df, ["g"], [F.col("rank")], {"ra": F.col("a").isNotNull(), "rb": F.col("b").isNotNull()}, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# --- percentiles -------------------------------------------------------------------------------------------------------


@given(st.lists(st.floats(allow_nan=False, width=64), min_size=1, max_size=200))
@settings(max_examples=60, deadline=None)
def test_keys_keep_order_and_value(values):
    v = np.array(sorted(values))
    k = quantiles.to_key(v)
    assert (np.diff(k) >= 0).all()
    with np.errstate(all="ignore"):
        back = quantiles.from_key(k)
    near = np.isclose(back, v, rtol=2.0**-32, atol=1e-300) | ~np.isfinite(v) | (np.abs(v) > 1.79e308)
    assert near.all()


@pytest.mark.parametrize("eps", [0.2, 0.05, 0.01])
def test_rank_error_is_bounded_after_merging(eps):
    rnd = np.random.default_rng(1)
    v = np.concatenate([np.exp(rnd.normal(3, 1, 30_000)), np.full(9_000, 77.0), np.zeros(2_000)])
    rnd.shuffle(v)
    k = int(np.ceil(quantiles.BITS / eps))
    one = [quantiles.compressed(quantiles.to_key(p) + (1 << quantiles.BITS), np.ones(len(p), dtype=np.int64), k) for p in np.array_split(v, 13)]
    nodes, n = quantiles.compressed(np.concatenate([a for a, _ in one]), np.concatenate([b for _, b in one]), k)
    assert n.sum() == len(v) and len(nodes) <= 3 * k + 1
    s = np.sort(v)
    for p in (0.01, 0.25, 0.5, 0.75, 0.9, 0.99):
        q, r = quantiles.quantiles(nodes, n, [p])[0], int(np.ceil(p * len(v)))
        lo, hi = np.searchsorted(s, q * (1 - 1e-9), "left"), np.searchsorted(s, q * (1 + 1e-9), "right")
        assert max(0, lo + 1 - r, r - hi) <= eps * len(v)


def test_digests_merge_over_matches(spark):
    rnd = random.Random(2)
    rows = [(m, r, rnd.choice([None, 0.0, 55.5, rnd.random() * 300])) for m in range(5) for r in (1, 2, None) for _ in range(80)] + [(9, 7, None), (9, 8, float("nan"))]
    df = spark.createDataFrame(rows, "match_id long, rallyid int, shotavgspeedkmh double").withColumns({c: F.lit(1) for c in ("g", "node", "n", "s")})
    got = {r.rallyid: r for r in quantiles.speed_percentiles(df).collect()}
    assert set(got) == {1, 2, None}
    for g, r in got.items():
        v = sorted(x for _, q, x in rows if q == g and x is not None and x == x)
        assert r.n == len(v) and r.rank_error == 0
        for c, p in quantiles.SPEED_PROBS.items():
            assert np.isclose(r[c], v[max(1, int(np.ceil(p * len(v)))) - 1], rtol=1e-9)
    assert quantiles.speed_percentiles(df.where("false")).count() == 0


def test_a_large_group_shrinks_before_the_shuffle(spark):
    df = spark.range(0, 60_000, 1, 3).selectExpr("1 as g0", "cast(id as double) as v")
    d = quantiles.digests(df, ["g0"], "v", eps=0.2)
    assert d.count() <= 3 * quantiles.BITS / 0.2
    r = quantiles.percentiles(d, ["g0"], {"p50": 0.5}, eps=0.2).first()
    assert abs(r.p50 - 30_000) <= 0.2 * 60_000 and 0 < r.rank_error <= 0.2 * 60_000


# --- nearest time --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_nearest_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_BITS", 4)
    rnd = random.Random(seed)
    hits = [(i, rnd.randrange(3), rnd.randrange(-40, 300)) for i in range(200)]
    audio = [(i, rnd.randrange(3), rnd.randrange(-40, 300)) for i in range(120)]
    want = set()
    for h, m, f in hits:
        c = [(abs(g - f), g, a) for a, k, g in audio if k == m and abs(g - f) <= 6]
        if c:
            want.add((h, min(c)[2], min(c)[1] - f))
    extra = {c: F.lit(0) for c in ("entity", "tick", "id", "side", "block", "due")}
    left = spark.createDataFrame(hits + hits[:30] + [(900, None, 5), (901, 1, None)], "hit_id long, match_id long, frame int").withColumns(extra)
    right = spark.createDataFrame(audio + audio[:30] + [(900, None, 5), (901, 1, None)], "audio_id long, match_id long, frame int").withColumns(extra)
    assert {tuple(r) for r in nearest.hits_with_impulse(left, right).collect()} == want
    assert nearest.hits_with_impulse(left, right.limit(0)).count() == 0


def test_one_hot_tick_holds_one_right_record():
    import pandas as pd

    part = pd.DataFrame({"entity": 1, "block": 0, "side": [0] * 5000 + [1] * 5000, "tick": [6] * 5000 + [9] * 5000, "id": [*range(5000), *range(5000)]})
    out = pd.concat(list(nearest._merge(6)(iter([part[:3000], part[3000:]]))))
    assert len(out) == 5000 and set(out["right_id"]) == {0}


# --- encoding --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tik():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=80) | st.text(alphabet="ab 的 \n'sre<|endoftext|>1é", max_size=300))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_public_library(tik, text):
    if any(unicodedata.category(c) in ("Cs", "Cn") for c in text) or set("\x1c\x1d\x1e\x1f") & set(text):
        return
    enc = bpe.Encoder(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    assert enc(text) == tik.encode_ordinary(text)


@given(st.binary(min_size=1, max_size=200))
@settings(max_examples=80, deadline=None)
def test_both_merges_agree(raw_bytes):
    ranks = bpe.load_ranks(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    assert bpe.merge_short(raw_bytes, ranks) == bpe.merge_long(raw_bytes, ranks) or raw_bytes in ranks


def test_encoding_of_a_table(spark, tik):
    texts = [None, "", "  \n ", "a" * 30_000, "字" * 5000, "x<|endoftext|>y", "don't  stop\t\t", "🏸 é" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit(1), "__text": F.lit("z")})
    got = {r.doc_id: r.ids for r in bpe.encoded(df).collect()}
    assert got == {i: (tik.encode_ordinary(t) if t else []) for i, t in enumerate(texts)}
    assert bpe.encoded(df.limit(0)).count() == 0


# --- leaks --------------------------------------------------------------------------------------------------------------------

ITEM = "Between marks 51702 and 76714 of reel quartz, the echo arrives late; with offset 11111 how many frames remain usable for the second analyst?"
ZH = "假设折起的记分牌出现在第28178秒记分助手仍要统计踩错的步子到第44139秒请问哪个标签必须撤回"


def test_leaks_in_altered_form(spark):
    p = leaks.plain(ITEM)
    items = [(1, "test", "en", ITEM), (2, "test", "zh", ZH), (3, "test", "en", None), (4, "test", "en", ""), (5, "test", "en", "short"), (None, "test", "en", ITEM)]
    docs = [
        (1, "lead in. " + ITEM.upper() + " tail"), (2, "> " + ITEM.replace(" ", "\n> ")), (3, "<b>" + ITEM[:70] + "</b>" + ITEM[70:100]), (4, "x" * 50_000 + p[10:70] + "y" * 50_000), (5, "x" + p[10:69] + "zz"),
        (6, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM)), (7, "前文" + ZH[5:29] + "后文"), (8, "前文" + ZH[5:28] + "后"), (9, None), (10, ""), (11, "a" * 70), (None, ITEM), (12, "é".join(["résumé", p[:60]])),
    ]
    d = spark.createDataFrame(docs + docs[:2], "doc_id long, text string").withColumns({"item_id": F.lit(0), "split": F.lit("a")})
    e = spark.createDataFrame(items + items[:2], "item_id long, split string, lang string, text string")
    got = sorted(tuple(r) for r in leaks.leaked_items(d, e).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (7, 2), (12, 1)]
    assert leaks.leaked_items(d, e.limit(0)).count() == 0 and leaks.leaked_items(d.limit(0), e).count() == 0


def test_a_full_filter_gives_the_same(spark, monkeypatch):
    e = spark.createDataFrame([(i, "t", "en", f"{ITEM} {i}") for i in range(6)], "item_id long, split string, lang string, text string")
    d = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    monkeypatch.setattr(leaks, "FILTER_BITS", 6)
    assert sorted(r.item_id for r in leaks.leaked_items(d, e).collect()) == list(range(6))


def test_long_texts_in_pieces_give_the_same(monkeypatch):
    p = leaks.plain(ITEM)
    search = leaks.Items([(1, "en", ITEM), (2, "zh", ZH)])
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 900))) for _ in range(40)]
    texts = [t[: i * 9] + (p[20:80] if i % 3 == 0 else ZH[4:28] if i % 3 == 1 else p[20:79] + "#") + t[i * 9 :] for i, t in enumerate(texts)] + ["", p]
    want = sorted(search.found(texts))
    monkeypatch.setattr(leaks, "PIECE_CHARS", 37)
    assert sorted(search.found(texts)) == want and {n for n, _ in want} == {*(i for i in range(40) if i % 3 < 2), 41}


def test_places_agree_exactly_over_a_stretch():
    rnd = random.Random(9)
    for _ in range(300):
        item = "".join(rnd.choice("ab") for _ in range(rnd.randrange(20, 90)))
        at, n = rnd.randrange(0, len(item)), rnd.randrange(15, 40)
        text = "".join(rnd.choice("ab") for _ in range(30)) + item[at : at + n] + "".join(rnd.choice("ab") for _ in range(30))
        want = leaks.shares(text, item, 24)
        assert bool(leaks.Items([(1, "zh", item)]).found([text])) == want


def test_many_items_are_joined_by_a_shuffle(spark):
    rnd = random.Random(10)
    line = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [(i, "t", "zh" if i % 3 else "en", line(rnd.randrange(20, 200))) for i in range(2000)]
    docs = []
    for i in range(300):
        t = items[rnd.randrange(2000)][3]
        a = rnd.randrange(0, max(1, len(t) - 60))
        docs.append((i, line(rnd.randrange(0, 300)) + t[a : a + rnd.randrange(20, 120)] + line(30)))
    want = {(d, i) for d, t in docs for i, _, lang, x in items if leaks.shares(t, x, 24 if lang == "zh" else 60)}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, split string, lang string, text string"))
        assert {tuple(r) for r in got.collect()} == want and len(want) > 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@given(st.text(alphabet="abc", max_size=150), st.text(alphabet="abc", max_size=40), st.integers(0, 30))
@settings(max_examples=150, deadline=None)
def test_every_shared_window_keeps_a_common_shingle(doc, item, at):
    doc = doc[:at] + item + doc[at:]
    own_d, hd = leaks.kept_shingles([doc], 24, 12)
    own_i, hi = leaks.kept_shingles([item], 24, 12)
    assert not leaks.shares(doc, item, 24) or set(hd.tolist()) & set(hi.tolist())


# --- cut texts -------------------------------------------------------------------------------------------------------------------


def test_structure():
    f = truncation.examined
    assert f('{"a": [1, "x\\"}"]}')["open"] is False and f('{"a": [1, "x')["open"] and f('{"a": [1]')["open"] and f('{"a": "x\\')["open"]
    assert f("It is (frame 12")["open"] and not f("It is done (24).")["open"] and not f("All fine :-(")["open"]
    assert f("half a char�")["broken"] and f("To be ...")["preview"] and f("so the [...]")["preview"] and f("but (more)")["preview"]
    assert f("| a | b |\n| 1 | 2")["open"] and not f("| a | b |\n| 1 | 2 |")["open"]
    assert f("He said “stop.”")["ended"] and f("完了。")["ended"] and not f("and then the")["ended"]
    assert f("Done.\n-- desk 12")["fragment"] == "-- desk 0" and f("Out, 21-19")["shape"] == "0-0"


def test_cut_texts_by_source(spark):
    rnd = random.Random(4)
    word = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    whole = [(f"note", f"{word(rnd.randrange(5, 90))}.\n— desk {i % 30}") for i in range(300)] + [("note", f"{word(rnd.randrange(5, 30))}.") for _ in range(200)]
    cut = [("note", (word(200))[:599] + "x") for _ in range(40)]  # a field of 600 characters
    logs = [("log", f"run {i}\n{word(9)}\nrun closed rc={i % 2}") for i in range(100)]
    lost = [("log", f"run {i}\n{word(9)} elapsed=1.") for i in range(4)]
    other = [("note", None), ("note", ""), ("note", "  \n"), (None, "fine."), (None, "not fi�")]
    texts = whole + cut + logs + lost + other
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("chars", "cut", "reason", "fragment", "texts")})
    got = {r.doc_id for r in truncation.cut_documents(df).collect()}
    n = len(whole)
    want = set(range(n, n + 40)) | set(range(n + 140, n + 144)) | {n + 148}
    assert got == want
    shares = {r.source: (r.texts, r.cut_texts) for r in truncation.cut_shares(df).collect()}
    assert shares == {"note": (540, 40), "log": (104, 4), "": (2, 1)}
    assert truncation.cut_documents(df.limit(0)).count() == 0


def test_copies_and_open_ends_are_no_normal_closing(spark):
    rnd = random.Random(5)
    word = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    whole = [f"{word(rnd.randrange(20, 90))}.\n— desk {i % 30}" for i in range(300)]
    reposts = [word(12) + " and the shuttl"] * 160  # a third of all rows is one cut text
    opened = [f"{word(30)}. Out at the line (frame 12" for _ in range(8)]
    previews = [f"{word(30)}. Watch the whole rally (more)" for _ in range(8)]
    own = [f"{word(30)}. More on Sunday..." for _ in range(8)]  # the writers' own closing
    df = spark.createDataFrame([(i, t, "note") for i, t in enumerate(whole + reposts + opened + previews + own)], "doc_id long, text string, source string")
    got = {r.doc_id: r.reason for r in truncation.judged(df).where("cut").collect()}
    assert got == {i: "no_closing" if i < 460 else "open_structure" if i < 468 else "preview" for i in range(300, 476)}
    assert [(r.texts, r.cut_texts) for r in truncation.cut_shares(df).collect()] == [(484, 176)]


def test_a_very_long_text_is_read_whole():
    assert truncation.examined("a b. " * 200_000 + "and the")["ended"] is False


def test_brackets_of_earlier_sentences_and_prose_that_begins_with_one():
    f = truncation.examined
    assert f("It fell (see the note. It was out.")["open"] and f("He said “stop. Then he left.")["open"] and not f("It fell (see the note. It was out.) Fine.")["open"]
    assert not f("All \x1b[31m red. Fine.")["open"]
    prose = f("[12:04] the rally went on and the shuttl")
    assert not prose["json"] and not prose["open"] and not prose["ended"]
    assert f('{"a": 1')["json"] and f("[1, 2")["json"] and f('["x')["json"] and f("{")["json"] and not f("[12:04] done.")["open"]


RUNS = {
    "blanks": "a" + " " * 10**6 + "b", "dots": "a" + "." * 10**6 + "b", "quotes": '"' * 10**6, "brackets": "(" * 500_000 + "]" * 500_000, "nested": "([" * 500_000, "tags": "<a" * 500_000, "tag": "<a" + " " * 10**6 + "b",
    "lines": "\n" * 10**6 + "x", "backslashes": "\\" * 10**6, "digits": "[" + "1" * 10**6 + "x", "json": "[" * 10**6, "blanks in a mark": "x read " + " " * 10**6 + "more", "fences": "```" * 300_000, "letters": "x" * 10**6, "mentions": "@a" * 500_000,
}


@pytest.mark.parametrize("name", RUNS)
def test_a_million_characters_are_read_in_linear_time(name):
    import time

    began = time.process_time()
    truncation.examined(RUNS[name])
    assert time.process_time() - began < 3


def test_one_automaton_reads_all_kinds_of_structure():
    of = lambda t: truncation.examined(t)["open_kinds"]
    assert of("<b>bold text.") == truncation.TAGS and of("<i>x</i> and <br> and <img src='a'/> done.") == 0 and of('a <span class="q') == truncation.TAGS | truncation.STRAIGHT or of('a <span class="q') == truncation.TAGS
    assert of("see [note.") == truncation.SQUARE and of('He said "stop.') == truncation.STRAIGHT and of('He said "stop."') == 0 and of(") (x.") == truncation.ROUND
    assert of('A 5\'11" player.') == 0 and of("Run:\n```\nif (x: [\n") == truncation.FENCES and of("Run:\n```\nif (x: [\n```\nDone.") == 0 and of("Tom &amp") == truncation.ESCAPES and of("x \\( y.") == 0
    assert of("(a [b) c.") == 0 and of("「甲『乙』丙。") == truncation.QUOTES


def test_long_closings_are_learnt_whole_and_loose_structure_counts_for_nothing(spark):
    rnd = random.Random(6)
    word = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    footer = "sent from the desk of the second analyst in the upper hall of the old court, all rights reserved by the club and its members " * 3
    notes = [("note", f"{word(rnd.randrange(5, 60))}.\n{footer}") for _ in range(100)] + [("note", f"{word(9)}.\n{footer[:-40]}"), ("note", f"{word(9)} and th")]
    loose = [("html", f"<div>{word(rnd.randrange(5, 60))}.") for _ in range(60)] + [("html", f"{word(9)} (so.")]
    rows = notes + loose
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: r.reason for r in truncation.judged(df).where("cut").collect()}
    assert got == {100: "no_closing", 101: "no_closing", 162: "open_structure"}


def test_a_field_limit_is_seen_in_distinct_texts_only(spark):
    rnd = random.Random(7)
    word = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    rows = [word(rnd.randrange(5, 20)) for _ in range(100)] + [(word(60))[:199] + "x" for _ in range(12)] + [word(19) + " again"] * 50
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], "doc_id long, text string, source string")
    limits = truncation.source_limits(truncation.distinct_texts(truncation.examine(df))).first()
    assert limits.texts == 113 and limits.char_limits == [200] and limits.byte_limits == [200] and limits.loose == 0


def test_digests_keep_types_and_nulls_and_stored_ones_join(spark):
    rnd = random.Random(13)
    big = 2**60 + 1
    rows = [(rnd.choice([None, big, big + 1]), rnd.choice([None, "a", "b"]), rnd.random() * 100) for _ in range(2000)]
    df = spark.createDataFrame(rows, "m long, t string, v double")
    d = quantiles.digests(df, ["m", "t"], "v", eps=0.2, bits=24)
    assert d.schema["m"].dataType == df.schema["m"].dataType and {(r.m, r.t) for r in d.select("m", "t").distinct().collect()} == {(m, t) for m, t, _ in rows}
    by = lambda parts: {r.t: (r.n, r.p50, r.rank_error) for r in quantiles.percentiles(parts, ["t"], {"p50": 0.5}, eps=0.2, bits=24).collect()}
    for t, (n, p50, e) in by(d).items():
        v = sorted(x for _, q, x in rows if q == t)
        assert n == len(v) and e == 24 * (n // 120) > 0 and abs(np.searchsorted(v, p50) - n / 2) <= e + 2
    assert set(by(d)) == set(by(quantiles.partial_digests(df, ["t"], "v", eps=0.2, bits=24))) == {None, "a", "b"}
