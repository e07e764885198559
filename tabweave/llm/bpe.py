"""Operator 1: BPE encoding and decoding by forced-boundary splitting.

Two bytes that stand together inside no vocabulary token can never be merged, so a
cut between them is certain. White space and the split pattern's pre-token bounds
are cuts of the same kind. Every fragment between cuts is encoded by itself and the
ids are put together again.

Defined results: a null text counts as empty; an empty text has no ids and decodes
to an empty text; null ids decode to an empty text; rows with equal keys stay apart;
other columns pass through untouched, but for a column named as an output, which is
replaced. An empty table gives an empty result. Texts are never truncated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blank_null, slices, text_batches, tidy
from .pieces import default_tokenizer, encoder, vocabulary

#: Bytes of text that are encoded at once: what their new chunks take on the way is a multiple of it.
AT_ONCE = 512 << 10


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str | None = None, decoded: str | None = None) -> DataFrame:
    """Adds array<int> `ids` of every whole text; with `decoded`, also what `decode` makes of them, in the same pass."""
    path = tokenizer or default_tokenizer()
    df = text_batches(df).drop(*[c for c in (ids, decoded) if c and c != text])
    df = df.withColumn(text, blank_null(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in slices(batches, text, AT_ONCE):
            flat, offsets, strings = e.encode(batch.column(batch.schema.get_field_index(text)).to_pylist(), decoded is not None)
            batch = _with(batch, ids, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32())))
            yield _with(batch, decoded, pa.array(strings, pa.string())) if decoded else batch
        e.shrink()

    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, *added]))


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Adds string `decoded`: the vocabulary has no decoder, so its tokens are joined by a space."""
    path = tokenizer or default_tokenizer()
    df = text_batches(df).drop(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary(path).strings
        for batch in slices(batches, ids, 2 << 20):
            rows = batch.column(batch.schema.get_field_index(ids))
            yield _with(batch, decoded, pa.array([" ".join([strings[i] for i in x.values.to_pylist()]) if x.is_valid else "" for x in rows], pa.string()))

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())]))


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """n_tokens and the SHA-256 of the ids as text and of the decoded text."""
    return df.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
