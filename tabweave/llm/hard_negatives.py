"""Operator 12: hard negatives by coordinate pruning over length buckets.

Rows are sorted by label and falling length and packed into blocks; a block is cut into
buckets of rows of about one length (and of one label where it has enough rows), which
hold, for every coordinate, their rows in the order of that coordinate of the vectors
scaled to length one. A search for inner products of `least` or more in a bucket asks for
a cosine of at least t = least / (anchor's length * longest in the bucket). Of the
anchor's FOCUS largest coordinates each gives a range of values that a row's coordinate
can have if its cosine is t or more; binary search in the sorted list gives the rows in
it, and the rows in all ranges are verified with their exact inner product. Buckets whose
length can't reach `least` are left out, and so are pairs of blocks and anchors.

The first pass finds each anchor's positives, the best rows of its label: a bucket's
threshold is the k-th best score so far. The second one finds, for each positive's score
p, the best rows of other labels with scores in [RATIO * p / 100, p]: the threshold is the
lower end or the k-th best so far. Bounds only ever leave out rows that can't be in a
result, so results are exact.

Scores are inner products of floor(256 * x), exact in double precision up to 2^53;
beyond that they are computed as Python integers (scores beyond 64 bits are an error).

Defined results: rows with a null id, label or vector, or with null or non-finite
components, take no part; vectors of different length aren't compared; an anchor id that
repeats is asked once (its smallest label and vector); rows that carry the anchor's id are
its own and no positives; other repeated rows each count; equal scores go to the smaller
id; anchors without positives, and positives without rows in their range (as all negative
scores), give no rows; an empty table gives an empty result; columns of other names are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep
from .vector_blocks import BLOCK, GROUP, meet, packed, renewed, whole

BUCKET, LEAST_BUCKET, FOCUS, RATIO = 1024, 256, 4, 80


def bucketed(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The block with its buckets' bounds and sorted coordinate lists."""
    label, n = a["label"], len(a["label"])
    changes = np.flatnonzero(np.diff(label)) + 1
    cuts, at = [0], 0
    while at < n:
        stop = min(n, at + BUCKET)
        inside = changes[(changes >= at + LEAST_BUCKET) & (changes < stop)]
        at = int(inside[0]) if len(inside) else stop
        cuts.append(at)
    unit, length = scaled(a["v"])
    lists = np.concatenate([np.argsort(unit[x:y], axis=0, kind="stable") for x, y in zip(cuts, cuts[1:], strict=False)]) if n else np.zeros(unit.shape)
    return a | {"cuts": np.array(cuts), "lists": lists.astype(np.uint16), "length": length}


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows at length one (zero rows as they are), and their lengths."""
    x = v.astype(np.float64)
    length = np.sqrt((x * x).sum(1))
    return x / np.where(length > 0, length, 1)[:, None], length


def feasible(q: float, t: float) -> tuple[float, float]:
    """The values that a coordinate of a unit vector can have, if its cosine with a unit vector that has q there is t or more."""
    if t <= 0:
        # the other coordinates may make up for any value
        return -1.0, 1.0
    spread = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(max(0.0, 1 - q * q))
    return (-1.0 if -q >= t else q * t - spread) - 1e-9, (1.0 if q >= t else q * t + spread) + 1e-9


class Block:
    """A block on its way through a task: vectors, unit vectors and sorted values of the buckets."""

    def __init__(self, a: dict[str, np.ndarray]):
        self.id, self.label, self.length = a["id"], a["label"], a["length"]
        self.raw = a["v"]
        self.x = a["v"].astype(np.float64)
        unit, _ = scaled(a["v"])
        self.unit = unit
        self.buckets = []
        for x, y in zip(a["cuts"].tolist(), a["cuts"].tolist()[1:], strict=False):
            lists = a["lists"][x:y].astype(np.int64)
            self.buckets.append((x, y, lists, np.take_along_axis(unit[x:y], lists, 0), float(self.length[x:y].max()), int(self.label[x:y].min()), int(self.label[x:y].max())))
        self.buckets.sort(key=lambda b: -b[4])
        self.high = float(np.abs(self.x).max(initial=0))
        self.looked = 0

    def rows(self, unit: np.ndarray, focus: np.ndarray, t: float, bucket: tuple) -> np.ndarray:
        """Rows of the bucket that lie in all feasible ranges."""
        x, y, lists, values = bucket[:4]
        if t <= 0:
            return np.arange(x, y)
        ranges = []
        for f in focus.tolist():
            low, high = feasible(float(unit[f]), t)
            a, b = np.searchsorted(values[:, f], low, "left"), np.searchsorted(values[:, f], high, "right")
            if b - a < y - x:
                ranges.append((b - a, f, a, b))
        if not ranges:
            return np.arange(x, y)
        hits = np.zeros(y - x, np.uint8)
        for _, f, a, b in ranges:
            hits[lists[a:b, f]] += 1
        return x + np.flatnonzero(hits == len(ranges))

    def scores(self, rows: np.ndarray, q: np.ndarray, raw: np.ndarray) -> np.ndarray:
        self.looked += len(rows)
        if self.high * float(np.abs(q).max(initial=0)) * len(q) < 2.0**53:
            return (self.x[rows] @ q).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(v.tolist(), raw.tolist(), strict=True)) for v in self.raw[rows]], object)

    def search(self, q: np.ndarray, raw: np.ndarray, least: float, skip) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) bucket by bucket; send() raises the least score."""
        length = float(np.sqrt(q @ q))
        unit = q / length if length > 0 else q
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for bucket in self.buckets:
            if skip(bucket[5], bucket[6]):
                continue
            reach = length * bucket[4]
            if least > reach * (1 + 1e-9) + 1e-6:
                break
            # lowered by more than rounding can add
            rows = self.rows(unit, focus, min(1.0, least / reach) - 1e-11 if reach > 0 and np.isfinite(least) else 0.0, bucket)
            least = max(least, (yield rows, self.scores(rows, q, raw)) or least)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by falling score, then id; exact for Python integers too."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k] if scores.dtype == object else np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def positives(b: Block, g: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    out: dict[str, list] = {"anchor_id": [], "positive_id": [], "positive_score": []}
    for i in range(len(g["id"])):
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, run = -np.inf, b.search(g["v"][i].astype(np.float64), g["v"][i], -np.inf, lambda low, high, own=g["label"][i]: own < low or own > high)
        found = next(run, None)
        while found is not None:
            rows, new = found
            good = (b.label[rows] == g["label"][i]) & (b.id[rows] != g["id"][i])
            ids, scores = best(np.concatenate([ids, b.id[rows[good]]]), np.concatenate([scores, new[good]]), k)
            least = float(scores[-1]) if len(ids) == k else -np.inf
            try:
                found = run.send(least)
            except StopIteration:
                found = None
        out["anchor_id"] += [int(g["id"][i])] * len(ids)
        out["positive_id"] += ids.tolist()
        out["positive_score"] += [int(s) for s in scores]
    return {c: np.array(v, np.int64) for c, v in out.items()}


def negatives(b: Block, g: dict[str, np.ndarray], k: int, ratio: int) -> dict[str, np.ndarray]:
    out: dict[str, list] = {"anchor_id": [], "positive_score": [], "negative_id": [], "negative_score": []}
    starts = np.concatenate([[0], np.cumsum(g["goals_n"])])
    for i in range(len(g["id"])):
        goals = [int(p) for p in sorted(set(g["goals"][starts[i] : starts[i + 1]].tolist())) if p >= 0]
        if not goals:
            continue
        held = {p: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for p in goals}
        run = b.search(g["v"][i].astype(np.float64), g["v"][i], goals[0] * ratio / 100, lambda low, high, own=g["label"][i]: low == high == own)
        found = next(run, None)
        while found is not None:
            rows, new = found
            other = b.label[rows] != g["label"][i]
            rows, new = rows[other], new[other]
            for p in goals:
                # in integers: score * 100 may not pass 2^63 for scores of at most 2^53
                good = (100 * new >= ratio * p) & (new <= p)
                if good.any():
                    held[p] = best(np.concatenate([held[p][0], b.id[rows[good]]]), np.concatenate([held[p][1], new[good]]), k)
            least = min(float(s[-1]) if len(s) == k else p * ratio / 100 for p, (_, s) in held.items())
            try:
                found = run.send(least)
            except StopIteration:
                found = None
        for p, (ids, scores) in held.items():
            out["anchor_id"] += [int(g["id"][i])] * len(ids)
            out["positive_score"] += [p] * len(ids)
            out["negative_id"] += ids.tolist()
            out["negative_score"] += [int(s) for s in scores]
    return {c: np.array(v, np.int64) for c, v in out.items()}


def mine(vectors: DataFrame, is_anchor: Column, label: Column, k: int = 5, n_positives: int = 5, ratio: int = RATIO, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = vectors.where(whole(vector)).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * 256)).alias("v"), is_anchor.alias("asks"))
    rows = rows.where("id is not null and label is not null").withColumns({"dim": F.size("v"), "short": -F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))})
    blocks = packed(rows, ["label", "short", "id"], min(block, 1 << 16), bucketed)
    once = keep(rows.where("asks").groupBy("id", "dim").agg(F.min(F.struct("label", "v", "short")).alias("a")).select("id", "dim", "a.*"))
    groups = packed(once, ["label", "short", "id"], GROUP)
    made: dict[int, Block] = {}

    def opened(a: dict[str, np.ndarray]) -> Block:
        if id(a) not in made or made[id(a)].id is not a["id"]:
            made.clear()
            made[id(a)] = Block(a)
        return made[id(a)]

    first = lambda column, n, *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(column[0]), column[1])) <= n
    shares = (F.col("g_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("g_high"))
    good = meet(blocks, groups, shares, lambda b, g: positives(opened(b), g, n_positives), "anchor_id long, positive_id long, positive_score long")
    good = keep(good.withColumn("in", first(("positive_score", "positive_id"), n_positives, "anchor_id")).where("in").drop("in"))
    goals = good.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list("positive_score")).alias("goals"))
    asking = packed(once.join(goals, "id"), ["label", "short", "id"], GROUP, extra=("goals",))
    other = (F.col("g_low") != F.col("g_high")) | (F.col("b_low") != F.col("b_high")) | (F.col("g_low") != F.col("b_low"))
    reaches = other & (F.greatest(F.col("g_least"), F.lit(0.0)) * ratio / 100 <= F.col("g_longest") * F.col("b_longest") * (1 + 1e-9) + 1e-6)
    bad = meet(blocks, asking, reaches, lambda b, g: negatives(opened(b), g, k, ratio), "anchor_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    bad = renewed(keep(bad).withColumn("rank", rank).where(F.col("rank") <= k))
    return good.join(bad, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
