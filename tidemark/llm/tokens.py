"""Token ids and token counts of text columns under a public tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Ids of every row's whole text, without special tokens.

    Returns ``id_col`` and ``ids`` (array of int), one row per input row, also
    for repeated rows. A null text and an empty text both have no ids: an empty
    list, never null. Strings of special tokens in a text are ordinary text.
    Extra columns are ignored. No shuffle: one pass over the two columns.
    """
    path = vocabulary or bpe.vocabulary_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = bpe.column_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                flat, ends = encoder.encode(texts)
                offsets = pa.array([0, *ends.tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], [id_col, "ids"])

    narrow = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` (long) of every row; 0 for a null or empty text."""
    path = vocabulary or bpe.vocabulary_path()
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        encoder = bpe.column_encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            sizes = encoder.count_tokens(texts)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(sizes, pa.int64())], [*keep, "n_tokens"])

    narrow = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    return narrow.mapInArrow(run, f"{schema}, n_tokens bigint")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Text of lists of ids, by an offset table over all entries' bytes; null lists give null.

    Bytes that are no UTF-8, which a cut list can have, come out as U+FFFD.
    """
    path = vocabulary or bpe.vocabulary_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        table = bpe.offset_table(bpe.column_encoder(path).encoder.ranks)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids, table).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`").cast("array<int>")).mapInArrow(run, f"`{id_col}` {kind}, text string")
