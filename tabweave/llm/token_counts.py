"""Operator 10: token counts from pre-token frequencies.

1. Count pre-tokens per task, add up by pre-token: the corpus's distinct pre-tokens.
2. Count the pieces of each distinct pre-token once.
3. Per document: pre-token frequencies joined to the pieces and summed. The `hot`
   most frequent pre-tokens (a fixed bound) are joined from a broadcast of at most
   that many entries; all others are joined by shuffle, and none of those is frequent.
No ids are made.

Defined results: null text counts as empty (0 bytes, 0 tokens); an input row gives
one output row even where keys repeat or are null; texts of any length are read whole;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_null, keep, slices, text_batches
from .pieces import chunks_of, default_tokenizer, vocabulary

#: Entries of the broadcast dictionary: some 30 MB in a worker.
HOT = 1 << 18
#: Distinct chunks that a task holds before it sends on what it has counted.
HELD = 300_000
#: Starts the key of a row without a rare pre-token; no pre-token is this followed by digits.
_NONE = "\x00"


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def pretoken_counts(df: DataFrame, path: str) -> DataFrame:
    """(pretoken, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = vocabulary(path), Counter()

        def out() -> pa.RecordBatch:
            n: Counter = Counter()
            for chunk, k in seen.items():
                for p in words.pretokens(chunk):
                    if isinstance(p, str):
                        n[p] += k
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["pretoken", "n"])

        for batch in slices(batches, "text"):
            for t in _texts(batch):
                seen.update(chunks_of(t))
            if len(seen) > HELD:
                yield out()
                seen.clear()
        yield out()

    return df.select("text").mapInArrow(run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(counts: DataFrame, path: str) -> DataFrame:
    """Adds `pieces`; each distinct pre-token is looked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([words.n_pieces(p) for p in batch.column(0).to_pylist()], pa.int32())], names=["pretoken", "n", "pieces"])

    return counts.select("pretoken", "n").mapInArrow(run, "pretoken string, n long, pieces int")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = 2048, hot: int = HOT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row."""
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    df = text_batches(docs).select(F.col(key).alias("key"), blank_null(text).alias("text"))
    pieces = keep(piece_counts(pretoken_counts(df, path), path))
    top = {r[0]: r[1] for r in pieces.orderBy(F.desc("n"), "pretoken").limit(hot).select("pretoken", "pieces").toLocalIterator()}
    known = spark.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, common, memo = vocabulary(path), known.value, {}

        def parts(chunk: str) -> tuple[int, tuple[str, ...]]:
            n, rare = 0, []
            for p in words.pretokens(chunk):
                k = 1 if isinstance(p, int) else common.get(p)
                if k is None:
                    rare.append(p)
                else:
                    n += k
            return n, tuple(rare)

        for batch in slices(batches, "text", 4 << 20):
            if len(memo) > HELD:
                memo.clear()
            rows: list[list] = [[], [], [], []]
            uids = batch.column(batch.schema.get_field_index("uid")).to_pylist()
            for uid, t in zip(uids, _texts(batch), strict=True):
                total, tail = 0, Counter()
                for chunk, k in Counter(chunks_of(t)).items():
                    if (found := memo.get(chunk)) is None:
                        found = memo[chunk] = parts(chunk)
                    total += k * found[0]
                    for p in found[1]:
                        tail[p] += k
                rows[0] += [uid] * (len(tail) + 1)
                rows[1] += [f"{_NONE}{uid}", *tail]
                rows[2] += [0, *tail.values()]
                rows[3] += [total] + [0] * len(tail)
            first = pa.array([x[:1] == _NONE and n == 0 for x, n in zip(rows[1], rows[2], strict=True)])
            # only the first of a document's rows carries its key and its bytes
            at = pa.compute.if_else(first, pa.compute.subtract(pa.compute.cumulative_sum(first.cast(pa.int64())), 1), None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), batch.column(batch.schema.get_field_index("key")).take(at), batch.column(batch.schema.get_field_index("n_bytes")).take(at), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())],
                names=["uid", "key", "n_bytes", "pretoken", "times", "known"],
            )

    kind = df.schema["key"].dataType.simpleString()
    each = df.select(F.monotonically_increasing_id().alias("uid"), "key", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(run, f"uid long, key {kind}, n_bytes long, pretoken string, times long, known long")
    total = (
        each.join(pieces.select("pretoken", "pieces"), "pretoken", "left")
        .groupBy("uid")
        .agg(F.max("key").alias(key), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("known") + F.col("times") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
    )
    return total.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
