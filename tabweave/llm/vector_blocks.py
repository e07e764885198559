"""Vectors in packed blocks of a bounded size, and queries that meet them block by block.

A block is one row: its number, what it holds at most (bounds for leaving out pairs) and
the arrays of its rows as bytes. Queries are packed into groups alike. Where groups meet
blocks, each block goes to one task, which holds it while the groups that need it stream
past, so that memory is a block's and a group's whatever the number of either.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

BLOCK, GROUP = 8192, 256
_META = "block long, part int, dim int, n int, low long, high long, longest double, least double, payload binary"


def whole(vector: str) -> Column:
    """True for vectors without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def renewed(df: DataFrame) -> DataFrame:
    """df with columns that a join with its own source can tell apart."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def matrix(v: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a list column, all of length dim; integers stay integers."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)


def narrow(v: np.ndarray) -> np.ndarray:
    """Integers in as few bytes as hold them all."""
    if v.dtype.kind != "i" or not v.size:
        return v
    least, most = int(v.min()), int(v.max())
    return v.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def packed(rows: DataFrame, order: list[str], size: int, add: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] = dict, extra: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of at most `size` rows of (id, label, dim, v, extra list columns), which follow each other in `order`.

    The rows are dealt by ranges of `order`, so a task takes a bounded share whatever the
    keys; every block holds vectors of one length. `add` may add arrays to a block's own.
    """

    def block(t: pa.Table, number: int, part: int) -> dict:
        dim = t.column("dim")[0].as_py()
        arrays = {"id": t.column("id").to_numpy(), "label": t.column("label").to_numpy(), "v": narrow(matrix(t.column("v"), dim))}
        for name in extra:
            col = t.column(name).combine_chunks()
            arrays[name], arrays[f"{name}_n"] = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
        length = np.sqrt((arrays["v"].astype(np.float64) ** 2).sum(1))
        least = float(arrays[extra[0]].min()) if extra and len(arrays[extra[0]]) else 0.0
        return {"block": number, "part": part, "dim": dim, "n": len(t), "low": int(arrays["label"].min()), "high": int(arrays["label"].max()), "longest": float(length.max()), "least": least, "payload": dump(add(arrays))}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, waiting = TaskContext.get().partitionId(), 0, []

        def out(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            rows = [block(t, (part << 32) + number, part)]
            return pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int64()), ("part", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("longest", pa.float64()), ("least", pa.float64()), ("payload", pa.binary())]))

        for b in batches:
            waiting.append(b)
            if sum(len(x) for x in waiting) < size:
                continue
            t = pa.Table.from_batches(waiting)
            while len(t) >= size or len(t) and t.column("dim")[0] != t.column("dim")[-1]:
                first = min(size, int((t.column("dim").to_numpy() == t.column("dim")[0].as_py()).sum()))
                yield out(t.slice(0, first))
                t = t.slice(first)
            waiting = t.to_batches()
        t = pa.Table.from_batches(waiting) if waiting else None
        while t is not None and len(t):
            first = min(size, int((t.column("dim").to_numpy() == t.column("dim")[0].as_py()).sum()))
            yield out(t.slice(0, first))
            t = t.slice(first)

    names = ["id", "label", "dim", "v", *extra, *[c for c in order if c not in ("id", "label", "dim")]]
    by = ["dim", *[c for c in order if c != "dim"]]
    return keep(rows.select(*names).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(cut, _META))


def meet(blocks: DataFrame, groups: DataFrame, near: Column, work: Callable[[dict, dict], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """The rows of work(block, group) for each pair of equal vector length for which `near` holds (of b_ and g_ columns)."""
    parts = blocks.rdd.getNumPartitions()
    bounds = ("dim", "low", "high", "longest", "least")
    mine = groups.select(F.col("block").alias("group"), *[F.col(c).alias(f"g_{c}") for c in bounds], F.explode(F.sequence(F.lit(0), F.lit(max(0, parts - 1)))).alias("part"))
    theirs = blocks.select("block", "part", *[F.col(c).alias(f"b_{c}") for c in bounds])
    pairs = mine.join(theirs, "part").where((F.col("g_dim") == F.col("b_dim")) & near).select("group", "block")
    sent = pairs.join(renewed(groups.select(F.col("block").alias("group"), "payload")), "group")
    both = blocks.select("block", F.lit(-1).cast("long").alias("group"), "payload").unionByName(sent.select("block", "group", "payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, group, payload = (batch.column(c)[i].as_py() for c in range(3))
                if group == -1:
                    number, held = block, load(payload)
                elif block == number and (found := work(held, load(payload))) is not None:
                    yield pa.RecordBatch.from_pydict(found)

    return both.repartition("block").sortWithinPartitions("block", "group").mapInArrow(run, schema)
