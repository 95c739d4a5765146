"""Mergeable quantile digests with a deterministic rank error (problem 4): compressed counts on a dyadic tree.

A digest is a set of (node, n). Node 1 is the whole universe of 2**bits ordered keys, the children of node v are 2v and 2v + 1, and the
leaf of key k is 2**bits + k. Digests merge by adding the counts of equal nodes.

Rows go through Python as Arrow tables, so group columns keep their types and nulls; groups are numbered and worked on as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlane.session import join_small

#: Bits of the universe: sign, exponent and 32 bits of the fraction of a double, so a key is within 2**-33 of its value.
BITS = 44
#: Nodes that a task gathers before it compresses, and before it passes them on.
BUFFER = 200_000
SPREAD = 64


def to_key(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Order-preserving keys of doubles, rounded to the nearest; -0.0 counts as 0.0."""
    raw = (np.asarray(values, dtype=np.float64) + 0.0).view(np.uint64)
    ordered = np.where(raw >> np.uint64(63) == 1, ~raw, raw | np.uint64(1 << 63))
    half = np.uint64(1) << np.uint64(63 - bits)
    return (np.where(ordered > ~half, ordered, ordered + half) >> np.uint64(64 - bits)).astype(np.int64)


def from_key(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The double a key stands for."""
    ordered = np.asarray(keys, dtype=np.int64).astype(np.uint64) << np.uint64(64 - bits)
    return np.where(ordered >> np.uint64(63) == 1, ordered & np.uint64((1 << 63) - 1), ~ordered).view(np.float64)


def added(nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct nodes with their counts added."""
    u, at = np.unique(nodes, return_inverse=True)
    return u, np.bincount(at, weights=counts, minlength=len(u)).astype(np.int64) if len(u) else counts


def compressed(nodes: np.ndarray, counts: np.ndarray, k: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The digest with every parent and its children that hold at most n / k together folded into the parent, bottom up.

    A node other than a leaf then holds at most n / k, so a rank is off by at most bits * n / k; at most about 3 k nodes are left.
    """
    nodes, counts = added(nodes, counts)
    most = int(counts.sum()) // k
    if not most:
        return nodes, counts
    kept_nodes, kept_counts = [], []
    for depth in range(bits, 0, -1):
        here = nodes >= 1 << depth
        if not here.any():
            continue
        mine, n = nodes[here], counts[here]
        up = nodes[~here]
        parents, at = np.unique(mine >> 1, return_inverse=True)
        total = np.bincount(at, weights=n).astype(np.int64)
        spot = np.searchsorted(up, parents)
        known = (spot < len(up)) & (up[np.minimum(spot, len(up) - 1)] == parents) if len(up) else np.zeros(len(parents), dtype=bool)
        total[known] += counts[~here][spot[known]]
        fold = total <= most
        stay = ~fold[at]
        kept_nodes.append(mine[stay])
        kept_counts.append(n[stay])
        nodes, counts = added(np.concatenate([up, parents[fold]]), np.concatenate([counts[~here], np.bincount(at, weights=n).astype(np.int64)[fold]]))
    return added(np.concatenate([nodes, *kept_nodes]), np.concatenate([counts, *kept_counts]))


def quantiles(nodes: np.ndarray, counts: np.ndarray, probs: list[float], bits: int = BITS) -> list[float]:
    """The value of rank max(1, ceil(p n)) for each p, off by the digest's rank error at most; NaN for an empty digest."""
    if not len(nodes):
        return [float("nan")] * len(probs)
    shift = bits - (np.frexp(nodes.astype(np.float64))[1] - 1).astype(np.int64)
    top = ((nodes + 1) << shift) - 1 - (1 << bits)
    order = np.lexsort((shift, top))
    cum = np.cumsum(counts[order])
    ranks = [max(1, int(np.ceil(round(p * cum[-1], 6)))) for p in probs]
    return [float(x) for x in from_key(top[order][np.searchsorted(cum, ranks)], bits)]


def _numbered(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group, a row of each group); a null is a value of its own."""
    ids = np.zeros(len(t), dtype=np.int64)
    for c in keys:
        codes = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes if isinstance(codes, pa.DictionaryArray) else codes.chunk(0)).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.unique(ids * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    return ids, np.unique(ids, return_index=True)[1]


def _summed(ids: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal nodes of a group added; sorted by group and node."""
    order = np.lexsort((nodes, ids))
    ids, nodes, counts = ids[order], nodes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(nodes) != 0)])[: len(ids)])
    return ids[first], nodes[first], np.add.reduceat(counts, first) if len(first) else counts


def _folded(t: pa.Table, keys: list[str], k: int, bits: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(the table with counts of equal nodes added and groups of more than k nodes compressed, the group number of each row, a row of ``t`` for each group)."""
    ids, row = _numbered(t, keys)
    ids, nodes, counts = _summed(ids, t["node"].to_numpy(), t["n"].to_numpy())
    edges = np.searchsorted(ids, np.arange(len(row) + 1))
    if (np.diff(edges) > k).any():
        parts = [compressed(nodes[a:b], counts[a:b], k, bits) if b - a > k else (nodes[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        ids = np.repeat(np.arange(len(row)), [len(a) for a, _ in parts])
        nodes, counts = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    out = t.select(keys).take(pa.array(row[ids])).append_column("node", pa.array(nodes, pa.int64())).append_column("n", pa.array(counts, pa.int64()))
    return out, ids, row


def _gather(keys: list[str], k: int, bits: int):
    """The digests of a task's own rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for part in parts:
            t = pa.Table.from_batches([part])
            nodes = pa.array(to_key(t["v"].to_numpy(), bits) + (1 << bits), pa.int64())
            held.append(_folded(t.select(keys).append_column("node", nodes).append_column("n", pa.array(np.ones(len(t), dtype=np.int64))), keys, k, bits)[0])
            size += len(held[-1])
            if size > BUFFER:
                one = _folded(pa.concat_tables(held), keys, k, bits)[0]
                held, size = [one], len(one)
                if size > BUFFER:
                    yield from one.to_batches()
                    held, size = [], 0
        if held:
            yield from _folded(pa.concat_tables(held), keys, k, bits)[0].to_batches()

    return run


def _sorted_groups(keys: list[str], emit):
    """``emit`` on tables of whole groups of a sorted stream: all that are complete go together, the last one waits for its rest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in parts:
            if not len(part):
                continue
            t = pa.concat_tables([*held, pa.Table.from_batches([part])]).combine_chunks()
            ids, _ = _numbered(t, keys)
            done = int(np.flatnonzero(ids == ids[-1])[0])
            if done:
                yield from emit(t.slice(0, done)).to_batches()
            held = [t.slice(done)]
        if held:
            yield from emit(pa.concat_tables(held)).to_batches()

    return run


def _named(df: DataFrame, group: list[str]) -> tuple[DataFrame, list[str], list[T.StructField]]:
    """The group columns under own names, so that none clashes with node or n."""
    keys = [f"g{i}" for i in range(len(group))]
    return df.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(group, keys)], "node", "n"), keys, [T.StructField(g, df.schema[c].dataType) for c, g in zip(group, keys)]


_DIGEST = [T.StructField("node", T.LongType()), T.StructField("n", T.LongType())]


def partial_digests(df: DataFrame, group: list[str], value: str, eps: float = 0.001, bits: int = BITS) -> DataFrame:
    """Digests of each task's own rows: ``group``, node, n, several of a group, not shuffled. A hot group shrinks here to at most about 3 * bits / eps nodes a task.
    Null and NaN values are left out."""
    keys = [f"g{i}" for i in range(len(group))]
    fields = [T.StructField(g, df.schema[c].dataType) for c, g in zip(group, keys)]
    slim = df.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(group, keys)], F.col(f"`{value}`").cast("double").alias("v")).where("v is not null and not isnan(v)")
    made = slim.mapInArrow(_gather(keys, _size(eps, bits), bits), T.StructType([*fields, *_DIGEST]))
    return made.select(*[F.col(g).alias(c) for c, g in zip(group, keys)], "node", "n")


def _size(eps: float, bits: int) -> int:
    return int(np.ceil(bits / eps))


def _spread(nodes: DataFrame, keys: list[str], fields: list[T.StructField], k: int, bits: int) -> DataFrame:
    """First merge: up to SPREAD tasks share a group. The number of partitions is named, as one whose data is small still holds many groups to work on."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = nodes.withColumn("s", F.pmod(F.spark_partition_id(), F.lit(SPREAD))).repartition(n, *keys, "s").sortWithinPartitions(*keys, "s")
    merged = salted.mapInArrow(_sorted_groups([*keys, "s"], lambda t: _folded(t, [*keys, "s"], k, bits)[0].drop_columns(["s"])), T.StructType([*fields, *_DIGEST]))
    return merged.repartition(n, *keys).sortWithinPartitions(*keys)


def merge_digests(parts: DataFrame, group: list[str], eps: float = 0.001, bits: int = BITS) -> DataFrame:
    """One digest per group from partial ones or from those of finer groups (tasks, other matches, other days): counts of equal nodes are added, then compressed.

    Two shuffles: up to SPREAD tasks merge a group's parts, then one. A null in a group column is a key of its own.
    """
    named, keys, fields = _named(parts, group)
    k = _size(eps, bits)
    made = _spread(named, keys, fields, k, bits).mapInArrow(_sorted_groups(keys, lambda t: _folded(t, keys, k, bits)[0]), T.StructType([*fields, *_DIGEST]))
    return made.select(*[F.col(g).alias(c) for c, g in zip(group, keys)], "node", "n")


def digests(df: DataFrame, group: list[str], value: str, eps: float = 0.001, bits: int = BITS) -> DataFrame:
    """A digest per group: ``group``, node, n; a rank read from it, or from any merge of such digests, is off by at most eps * n. A group without values has none."""
    return merge_digests(partial_digests(df, group, value, eps, bits), group, eps, bits)


def percentiles(parts: DataFrame, group: list[str], probs: dict[str, float], eps: float = 0.001, bits: int = BITS) -> DataFrame:
    """``group``, n, a column per entry of ``probs``, and rank_error: by how many ranks a percentile may be off at most (0: exact).

    ``parts`` are digests, partial, finer or whole; they are merged and read in one go, in two shuffles.
    """
    named, keys, fields = _named(parts, group)
    k, names = _size(eps, bits), list(probs)

    def read(t: pa.Table) -> pa.Table:
        d, ids, row = _folded(t, keys, k, bits)
        nodes, counts = d["node"].to_numpy(), d["n"].to_numpy()
        edges = np.searchsorted(ids, np.arange(len(row) + 1))
        n = np.add.reduceat(counts, edges[:-1])
        values = np.array([quantiles(nodes[a:b], counts[a:b], list(probs.values()), bits) for a, b in zip(edges[:-1], edges[1:])])
        out = t.select(keys).take(pa.array(row)).append_column("n", pa.array(n, pa.int64()))
        for i in range(len(names)):
            out = out.append_column(f"p{i}", pa.array(values[:, i], pa.float64()))
        return out.append_column("rank_error", pa.array(bits * (n // k), pa.int64()))

    schema = T.StructType([*fields, T.StructField("n", T.LongType()), *[T.StructField(f"p{i}", T.DoubleType()) for i in range(len(names))], T.StructField("rank_error", T.LongType())])
    made = _spread(named, keys, fields, k, bits).mapInArrow(_sorted_groups(keys, read), schema)
    return made.select(*[F.col(g).alias(c) for c, g in zip(group, keys)], "n", *[F.col(f"p{i}").alias(p) for i, p in enumerate(names)], "rank_error")


SPEED_PROBS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
#: Of the coarse percentiles: rank error by the number of values, and bits of the universe (a key is within 2**-13 of its value).
COARSE_EPS, COARSE_BITS = 0.05, 24


def speed_digests(sidecar: DataFrame) -> DataFrame:
    """A digest of shotavgspeedkmh per match and rallyid: match_id, rallyid, node, n."""
    return digests(sidecar, ["match_id", "rallyid"], "shotavgspeedkmh")


def speed_percentiles(sidecar: DataFrame) -> DataFrame:
    """Percentiles of shotavgspeedkmh per rallyid, read from the merged digests of the tasks; every row with a value counts, a null
    rallyid is a group of its own. Columns: rallyid, n, p01 .. p99, rank_error. Stored digests of matches (``speed_digests``) give the same."""
    return percentiles(partial_digests(sidecar, ["rallyid"], "shotavgspeedkmh"), ["rallyid"], SPEED_PROBS)


def coarse_percentiles(sidecar: DataFrame) -> DataFrame:
    """Percentiles of shotavgspeedkmh per shotspeedquality, folded from some hundred values on: shotspeedquality, n, p01 .. p99, rank_error."""
    return percentiles(partial_digests(sidecar, ["shotspeedquality"], "shotavgspeedkmh", COARSE_EPS, COARSE_BITS), ["shotspeedquality"], SPEED_PROBS, COARSE_EPS, COARSE_BITS)


def checked_percentiles(sidecar: DataFrame) -> DataFrame:
    """``coarse_percentiles`` against the values themselves: shotspeedquality, n, rank_error, within (whether each percentile's rank is off by rank_error at most).

    The ranks that a percentile stands for are counted in one aggregation, values within a key's rounding counting as equal.
    """
    c = coarse_percentiles(sidecar)
    v = sidecar.select("shotspeedquality", F.col("shotavgspeedkmh").cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    j = join_small(v.withColumn("q", F.coalesce("shotspeedquality", F.lit("\0"))), c.withColumn("q", F.coalesce("shotspeedquality", F.lit("\0"))).drop("shotspeedquality"), ["q"], "inner")
    slack = lambda p, up: F.col(p) + (1 if up else -1) * F.abs(F.col(p)) * 2.0 ** (13 - COARSE_BITS)
    g = j.groupBy("shotspeedquality", "n", "rank_error").agg(*[F.struct(F.count_if(F.col("__v") < slack(p, False)).alias("lo"), F.count_if(F.col("__v") <= slack(p, True)).alias("hi")).alias(p) for p in SPEED_PROBS])
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.round(F.lit(q) * F.col("n"), 6)))
    return g.select("shotspeedquality", "n", "rank_error", F.forall(F.array(*[F.greatest(F.col(f"{p}.lo") + 1 - rank(q), rank(q) - F.col(f"{p}.hi")) <= F.col("rank_error") for p, q in SPEED_PROBS.items()]), lambda ok: ok).alias("within"))
