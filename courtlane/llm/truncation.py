"""Texts that were cut by a field limit, a preview or a broken transfer (problem 9).

One stack automaton reads each text from its first to its last character: round, square and curly brackets, typographic and straight quotes, tags, code
fences and, where the text is JSON, its strings, escapes, objects and arrays. It says which kinds of structure the text uses and which it leaves open. A text
can also end in a broken character or escape, in a preview's mark, inside a table row, at a field's limit, or without a terminator.

What counts is learnt per source: kinds of structure that its texts leave open as a matter of course count for nothing; lengths where its texts pile up are
field limits; fragments that many of its distinct texts close with (signatures, tag lines, footers) and shapes of last tokens are normal closings. Copies of one
text teach once, and texts with an open structure or a preview mark teach no closing; a bare ellipsis may be the writer's own ("To be continued...").
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlane.session import join_small, staged

#: Characters that end a sentence, that may follow its end, and marks that a preview leaves where it cut.
TERMINATORS = ".!?。！？｡…؟۔।"
CLOSERS = ")]}\"'”’»」』）】*_`"
PREVIEW = re.compile(r"(?:\[(?:\.\.\.|…)\]|\((?:more|continued)\)|(?:read|see) {0,4}(?:on|more)|\.\.\.|…)$", re.IGNORECASE)
#: Characters at a text's end that can hold a preview mark.
_MARK_CHARS = 24
#: Share of a source's distinct texts that must close with a fragment (or a shape) to make it a normal closing, and the least number of them.
CLOSING_SHARE, CLOSING_TEXTS = 0.0075, 3
#: Share of a source's distinct texts that must have a normal closing for it to be required.
REQUIRED_SHARE = 0.85
#: Share of a source's distinct texts that pile up at a field limit, how many times the usual number of texts of one length that is, and the least number of them.
LIMIT_SHARE, LIMIT_TIMES, LIMIT_TEXTS = 0.01, 5, 5
#: A kind of structure counts for nothing in a source if this share of its distinct texts, and of those that use the kind, leave it open.
LOOSE_OF_ALL, LOOSE_OF_USERS, LOOSE_TEXTS = 0.10, 0.30, 3

#: The kinds of structure, one bit each.
ROUND, SQUARE, CURLY, QUOTES, STRAIGHT, TAGS, FENCES, ESCAPES, ROWS, JSON = (1 << i for i in range(10))
_KINDS = 10
_PAIRS = {"(": (")", ROUND), "（": ("）", ROUND), "[": ("]", SQUARE), "【": ("】", SQUARE), "{": ("}", CURLY), "“": ("”", QUOTES), "「": ("」", QUOTES), "『": ("』", QUOTES), "«": ("»", QUOTES)}
_ENDS = frozenset(c for c, _ in _PAIRS.values())
#: After these a bracket opens nothing (smileys, terminal escapes), and after these a straight quote doesn't.
_NO_OPENING = frozenset(":;-=8\x1b")
_WORD = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Tags that have no end, or whose end may be left out.
_ENDLESS = frozenset("area base br col dd dt embed hr img input li link meta option p param source tbody td tfoot th thead tr track wbr".split())
_TOKEN = re.compile(r"\\.|```|\"|[" + re.escape("".join(_PAIRS) + "".join(sorted(_ENDS))) + r"]|<(/?)([A-Za-z][A-Za-z0-9]*+)(?:\s[^<>]*+)?>|(</?[A-Za-z][A-Za-z0-9]*+(?:\s++[\w:-]++\s*+=[^<>]*+)?\Z)", re.DOTALL)
_BREAK = re.compile(r"\n|[.!?…]++[" + re.escape(CLOSERS) + r"]*+(\s*+)|[。！？｡]++[" + re.escape(CLOSERS) + r"]*+\s*+")
_HALF_ESCAPE = re.compile(r"(?:&(?:#x?[0-9a-fA-F]+|amp|lt|gt|quot|apos|nbsp)|\\u[0-9a-fA-F]{0,3}|%[0-9A-F]{2}%[0-9A-F]?)$")
_JSON_MARK = re.compile(r'["\\{}\[\]]')
_JSON_ENDS = {"}": "{", "]": "["}
_JSON_START = re.compile(r'\s*(?:\{\s*(?:"|\}|$)|\[\s*(?:["{\[\]]|$|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\s*(?:,|\]\s*$|$)|(?:true|false|null)\b\s*(?:,|\]\s*$|$)))')


def json_open(text: str) -> bool:
    """Whether a text that starts as JSON ends inside a string, an escape, an object or an array."""
    stack, quoted, skip = [], False, -1
    for m in _JSON_MARK.finditer(text):
        c, at = m.group(), m.start()
        if at <= skip:
            continue
        if quoted:
            if c == "\\":
                skip = at + 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]" and stack and stack[-1] == _JSON_ENDS[c]:
            stack.pop()
    return quoted or bool(stack) or skip >= len(text)


def structure(text: str) -> tuple[int, int]:
    """(kinds used, kinds open at the end) of a text, by one stack; linear in the text.

    A closing mark closes the nearest opener of its own, with all that was opened inside; without one it closes nothing. Smileys, terminal escapes and escaped
    characters open nothing, a straight quote after a letter or digit (an inch mark) opens none either, tags without an end stay off the stack, and a tag that
    breaks off is open. Inside a code fence only the fence's end is read.
    """
    stack: list[tuple[str, int]] = []
    depth = dict.fromkeys((*_ENDS, '"'), 0)
    used = unfinished = 0
    fenced = False

    def close(mark: str) -> None:
        while True:
            top = stack.pop()[0]
            depth[top] -= 1
            if top == mark:
                return

    for m in _TOKEN.finditer(text):
        c = m.group()
        if c == "```":
            used, fenced = used | FENCES, not fenced
        elif fenced:
            continue
        elif c in _ENDS:
            if depth[c]:
                close(c)
        elif c in _PAIRS:
            at = m.start()
            if not at or text[at - 1] not in _NO_OPENING:
                pair = _PAIRS[c]
                used |= pair[1]
                stack.append(pair)
                depth[pair[0]] += 1
        elif c == '"':
            at = m.start()
            if depth[c]:
                close(c)
            elif not at or text[at - 1] not in _WORD:
                used |= STRAIGHT
                stack.append((c, STRAIGHT))
                depth[c] += 1
        elif c[0] == "\\":
            continue
        elif m.group(3):
            used, unfinished = used | TAGS, TAGS
        else:
            name = "<" + m.group(2).lower()
            if m.group(1):
                if depth.get(name):
                    close(name)
            elif name[1:] not in _ENDLESS and not c.endswith("/>"):
                used |= TAGS
                stack.append((name, TAGS))
                depth[name] = depth.get(name, 0) + 1
    open_ = unfinished | (FENCES if fenced else 0)
    for _, kind in stack:
        open_ |= kind
    return used, open_


def hash64(text: str) -> int:
    """64 bits of a text, the same on every worker."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def examined(text: str) -> dict:
    """Structural features of a text that isn't blank, in time linear in its length. open_kinds and used_kinds are masks; fragment is all that follows the last
    sentence end (digits and mentions made alike), shape the last token if it has no letters."""
    body = text.rstrip()
    out = {"broken": body.endswith("\ufffd"), "json": False, "open": False, "open_kinds": 0, "used_kinds": 0, "preview": False, "dots": False, "ended": False, "fragment": None, "shape": None, "chars": len(text), "bytes": len(text.encode("utf-8", "surrogatepass")), "copy": hash64(body)}
    if _JSON_START.match(body):
        out["json"], out["open"], out["used_kinds"] = True, json_open(body), JSON
        out["open_kinds"] = JSON if out["open"] else 0
        return out
    tail = body[-_MARK_CHARS:]
    mark = PREVIEW.search(tail)
    rest = body
    if mark:
        out["preview"], out["dots"] = True, not mark.group().strip(".…")
        rest = body[: len(body) - len(tail) + mark.start()].rstrip()
        if not out["dots"] and mark.group()[0] not in "[(":
            rest = (rest[:-3] if rest.endswith("...") else rest[:-1] if rest.endswith("…") else rest).rstrip()
    core = rest.rstrip(CLOSERS)
    out["ended"] = bool(core) and core[-1] in TERMINATORS
    cut = 0
    for m in _BREAK.finditer(rest):
        if m.group(1) != "":
            cut = m.end()
    used, open_ = structure(rest)
    if _HALF_ESCAPE.search(body[-16:]):
        used, open_ = used | ESCAPES, open_ | ESCAPES
    out["fragment"] = re.sub(r"\d+", "0", re.sub(r"[#@]\w+", "#", rest[cut:].strip().lower())) or None
    shape = re.sub(r"\d+", "0", body.rsplit(None, 1)[-1])
    out["shape"] = shape if shape != "0" and not re.search(r"[^\W\d_]", shape) and shape[-1] not in TERMINATORS else None
    row = body.rsplit("\n", 1)[-1].strip()
    if row.startswith("|"):  # a row of a table
        used |= ROWS
        open_ |= 0 if row.endswith("|") and len(row) > 1 else ROWS
    out["open"], out["open_kinds"], out["used_kinds"] = bool(open_), open_, used
    return out


_FEATURES = "broken boolean, json boolean, open_kinds int, used_kinds int, preview boolean, dots boolean, ended boolean, fragment long, shape long, chars long, bytes long, copy long"


def examine(documents: DataFrame) -> DataFrame:
    """doc_id, source and the structural features of every text that isn't null, empty or blank; fragment and shape as hashes of all their characters."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    names = [f.split()[0] for f in _FEATURES.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part[[bool(t.strip()) for t in part["text"]]]
            found = [examined(t) for t in part["text"]]
            for row in found:
                for c in ("fragment", "shape"):
                    row[c] = None if row[c] is None else hash64(row[c])
            features = pd.DataFrame(found, columns=names).astype({"fragment": "Int64", "shape": "Int64"})
            yield pd.concat([part[["doc_id", "source"]].reset_index(drop=True), features], axis=1)

    return slim.mapInPandas(run, f"doc_id long, source string, {_FEATURES}")


def distinct_texts(features: DataFrame) -> DataFrame:
    """One row per source and distinct text: copies agree in all features but trailing blanks."""
    return features.groupBy("source", "copy").agg(*[F.max(c).alias(c) for c in features.columns if c not in ("doc_id", "source", "copy")])


def source_limits(texts: DataFrame) -> DataFrame:
    """Per source, from its distinct texts: texts, char_limits and byte_limits (lengths where they pile up and beyond which there is next to none), and loose, the mask
    of the kinds of structure that count for nothing.

    One count of (source, unit, length) serves all of it. At most 1 / LIMIT_SHARE lengths of a source can pile up; only these are compared with the lengths around.
    """
    item = lambda unit, at: F.struct(F.lit(unit).alias("unit"), at.cast("long").alias("length"))
    bit = lambda mask, i: F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, item(mask, F.lit(i)))
    tall = F.array_compact(F.array(item("chars", F.col("chars")), item("bytes", F.col("bytes")), *[bit(m, i) for m in ("used_kinds", "open_kinds") for i in range(_KINDS)]))
    n = staged(texts.select("source", F.explode(tall).alias("l")).groupBy("source", "l.unit", "l.length").agg(F.count("*").alias("n")), "lengths")
    count = lambda unit, i: F.coalesce(F.sum(F.when((F.col("unit") == unit) & (F.col("length") == i), F.col("n"))), F.lit(0))
    texts_ = F.sum(F.when(F.col("unit") == "chars", F.col("n")))
    loose = [F.when((count("open_kinds", i) >= LOOSE_TEXTS) & (count("open_kinds", i) >= LOOSE_OF_ALL * texts_) & (count("open_kinds", i) >= LOOSE_OF_USERS * count("used_kinds", i)), 1 << i).otherwise(0) for i in range(_KINDS)]
    total = staged(n.groupBy("source").agg(texts_.alias("texts"), sum(loose[1:], loose[0]).alias("loose")), "totals")
    piles = join_small(n.where("unit in ('chars', 'bytes')"), total, ["source"], "inner").where(F.col("n") >= F.greatest(LIMIT_SHARE * F.col("texts"), F.lit(LIMIT_TEXTS)))
    piles = piles.groupBy("source", "unit").agg(F.collect_list(F.struct("length", "n", "texts")).alias("piles"))
    seen = join_small(n.where("unit in ('chars', 'bytes')"), piles, ["source", "unit"], "inner").select("source", "unit", "length", "n", F.explode("piles").alias("p"))
    off = F.col("length") - F.col("p.length")
    seen = seen.groupBy("source", "unit", "p").agg(F.coalesce(F.sum(F.when(off.between(-40, -4), F.col("n"))), F.lit(0)).alias("near"), F.coalesce(F.sum(F.when(off >= 4, F.col("n"))), F.lit(0)).alias("beyond"))
    limits = seen.where((F.col("p.n") >= LIMIT_TIMES * F.col("near") / 37) & (F.col("beyond") <= 0.02 * F.col("p.texts"))).groupBy("source").agg(*[F.collect_set(F.when(F.col("unit") == u, F.col("p.length"))).alias(f"{u[:-1]}_limits") for u in ("chars", "bytes")])
    return join_small(total, limits, ["source"])


def _open() -> Column:
    """Whether a structure that counts in the source is open."""
    return F.col("open_kinds").bitwiseAND(F.bitwise_not(F.col("loose"))) != 0


def _at_limit() -> Column:
    at = F.array_contains("char_limits", F.col("chars")) | F.exists("byte_limits", lambda m: F.abs(m - F.col("bytes")) <= 3)
    return F.coalesce(at, F.lit(False))


def source_rules(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """``limits`` with what else a source teaches: usual_fragments and usual_shapes (at most 1 / CLOSING_SHARE each) and whether one of these fragments is required."""
    t = join_small(texts, limits, ["source"], "inner")
    sound = ~F.col("broken") & ~_at_limit() & ~F.col("json")
    teaches = sound & ~_open() & (F.col("dots") | ~F.col("preview"))
    item = lambda kind, value, good: F.struct(F.lit(kind).alias("kind"), value.alias("value"), good.cast("int").alias("good"))
    tall = F.array_compact(F.array(item("sound", F.lit(0).cast("long"), sound), *[F.when(F.col(c).isNotNull(), item(c, F.col(c), teaches)) for c in ("fragment", "shape")]))
    g = t.select("source", F.explode(tall).alias("c")).groupBy("source", "c.kind", "c.value").agg(F.count("*").alias("n"), F.sum("c.good").alias("good"))
    g = staged(g.where((F.col("kind") == "sound") | (F.col("good") >= CLOSING_TEXTS)), "closings")
    usual = join_small(g.where("kind <> 'sound'"), g.where("kind = 'sound'").select("source", F.col("good").alias("sound")), ["source"], "inner").where(F.col("good") >= CLOSING_SHARE * F.col("sound"))
    rules = usual.groupBy("source").agg(*[F.collect_list(F.when(F.col("kind") == c, F.col("value"))).alias(f"usual_{c}s") for c in ("fragment", "shape")], F.sum(F.when(F.col("kind") == "fragment", F.col("n"))).alias("closed"))
    return join_small(limits, rules, ["source"]).withColumn("required", F.coalesce(F.col("closed") >= REQUIRED_SHARE * F.col("texts"), F.lit(False))).drop("closed")


def judged(documents: DataFrame) -> DataFrame:
    """Per text that isn't null, empty or blank: doc_id, source, cut, reason (broken_character, open_structure, preview, field_limit, no_terminator, no_closing)."""
    return judged_features(staged(examine(documents), "endings"))


def judged_features(f: DataFrame) -> DataFrame:
    """The verdicts (see ``judged``) over features that stand in a table: the sources' rules, one row per source, are written and then sent to all tasks once."""
    texts = distinct_texts(f)
    rules = staged(source_rules(texts, staged(source_limits(texts), "limits")), "rules")
    f = join_small(f, rules, ["source"])
    usual = lambda c: F.coalesce(F.array_contains(f"usual_{c}s", F.col(c)), F.lit(False))
    reason = (
        F.when(F.col("broken"), "broken_character")
        .when(_open(), "open_structure")
        .when(F.col("json"), F.lit(None))
        .when(F.col("preview") & ~F.col("dots"), "preview")
        .when(usual("fragment"), F.lit(None))
        .when(F.col("preview"), "preview")
        .when(F.col("required"), "no_closing")
        .when(F.col("ended"), F.lit(None))
        .when(_at_limit(), "field_limit")
        .when(usual("shape"), F.lit(None))
        .otherwise("no_terminator")
    )
    return f.select("doc_id", "source", reason.alias("reason")).withColumn("cut", F.col("reason").isNotNull())


def cut_documents(documents: DataFrame) -> DataFrame:
    """doc_id of every document whose text was cut. Null, empty and blank texts are no cases; a null source is a source of its own."""
    return judged(documents).where("cut").select("doc_id").distinct()


def cut_shares(documents: DataFrame) -> DataFrame:
    """Per source: texts that aren't blank, how many are cut, and their share. Columns: source ('' for null), texts, cut_texts, share."""
    return judged(documents).groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut_texts")).withColumn("share", F.col("cut_texts") / F.col("texts"))
