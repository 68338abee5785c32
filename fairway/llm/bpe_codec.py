"""BPE encoding and decoding of whole texts with the prefix encoder of fairway.llm.bpe."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.llm.bpe import piece_table, token_texts, vocabulary_path
from fairway.llm.common import by_bytes, tidy


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(vocabulary)
        for batch in by_bytes(batches, "text", 1 << 19):
            ids, bounds = table.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    return run


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row, as the tokenizers library encodes without added tokens, truncation or padding.

    Null and empty texts give no ids; null ids and repeated rows pass through; other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_encode(vocabulary)), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


_TEXTS: dict[str, np.ndarray] = {}


def _strings(vocabulary: str) -> np.ndarray:
    """The token texts by id, as bytes; kept for the life of the worker."""
    if vocabulary not in _TEXTS:
        text = token_texts(vocabulary_path(vocabulary))
        _TEXTS[vocabulary] = np.array([text.get(i, "").encode() for i in range(max(text) + 1)], object)
    return _TEXTS[vocabulary]


def _decode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _strings(vocabulary)
        for batch in batches:
            ids, ends = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            shown = [b" ".join(texts[ids[a:b]].tolist()).decode() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string())], names=["id", "text"])

    return run


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) per row of ids: as the library decodes with special tokens kept; this vocabulary's tokens joined by a space.

    Null ids lists decode to the empty text.
    """
    kind = df.schema[id_col].dataType.simpleString()
    lists = F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")
    return df.select(F.col(id_col).alias("id"), lists).mapInArrow(tidy(_decode(vocabulary)), f"id {kind}, text string").withColumnRenamed("id", id_col)


def _digest(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _strings(vocabulary)
        decimals = np.array([str(i).encode() for i in range(len(texts))], object)
        for batch in batches:
            ids, ends = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            rows = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
            sha = lambda words: [hashlib.sha256(b" ".join(words[r].tolist())).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(sha(decimals)), pa.array(sha(texts))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: digests of the decimal ids joined by a space and of the decoded text."""
    kind = df.schema[id_col].dataType.simpleString()
    encoded = encode(df, vocabulary, id_col, text_col)
    return encoded.mapInArrow(tidy(_digest(vocabulary)), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
