"""Token counts by batch encoding: lengths only, batches balanced by bytes, texts split at safe boundaries.

The word vocabulary's normaliser and pre-tokenizer drop white space, so a cut at ASCII white space never changes a
token. Each batch is cut there, its distinct pieces are encoded once by the library, and a text's count is the sum over
its pieces; a long text costs no more memory than its share of a batch. Other vocabularies are encoded in whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.llm.bpe import split_pieces, vocabulary_path
from fairway.llm.common import by_bytes, tidy

#: Bytes of text in one batch of the encoder, and bytes of distinct pieces in one call of the library.
BATCH, CALL = 8 << 20, 1 << 16
#: Distinct pieces whose counts a worker keeps.
PIECES = 600_000


class Counter:
    """Token counts of pieces or texts, by the library of the vocabulary file."""

    def __init__(self, name: str):
        path = vocabulary_path(name)
        self.known: dict[bytes, int] = {}
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.lengths = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
        self.border = next((s.content for s in t.get_added_tokens_decoder().values() if s.special and not (s.normalized or s.lstrip or s.rstrip or s.single_word)), None)
        # safe if white space leaves no trace in the tokens and a special string separates pieces
        self.cuts = self.border is not None and t.encode("a \t\n b", add_special_tokens=False).tokens == t.encode("a", add_special_tokens=False).tokens + t.encode("b", add_special_tokens=False).tokens
        self.mark = t.token_to_id(self.border) if self.border else None
        self.encode = lambda texts: [np.asarray(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    def count_pieces(self, pieces: list[bytes]) -> np.ndarray:
        """Counts of distinct pieces; those not known yet go to the library, many to a call with a special string between."""
        if len(self.known) + len(pieces) > PIECES:
            self.known = {}
        known, mark = self.known, self.border.encode()
        new = [p for p in pieces if p not in known]
        odd = [p for p in new if not p or mark in p]
        known.update(zip(odd, self.lengths([p.decode() for p in odd])))
        plain = [p for p in new if p and mark not in p]
        sizes = np.cumsum([len(p) for p in plain]) if plain else np.empty(0, np.int64)
        calls = np.searchsorted(sizes, np.arange(0, (int(sizes[-1]) if plain else 0) + CALL, CALL)).tolist()
        calls[-1] = len(plain)
        groups = [plain[a:b] for a, b in zip(calls, calls[1:]) if b > a]
        for i in range(0, len(groups), 16):
            batch = groups[i : i + 16]
            for group, ids in zip(batch, self.encode([mark.join(g).decode() for g in batch])):
                at = np.r_[-1, np.flatnonzero(ids == self.mark), len(ids)]
                known.update(zip(group, (np.diff(at) - 1).tolist()))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def count(self, texts: pa.Array) -> np.ndarray:
        if not self.cuts:
            return np.array(self.lengths(pc.fill_null(texts, "").to_pylist()), np.int64)
        pieces, order, bounds = split_pieces(texts)
        total = np.r_[0, np.cumsum(self.count_pieces(pieces)[order])] if len(order) else np.zeros(1, np.int64)
        return np.diff(total[bounds])


_COUNTERS: dict[str, Counter] = {}


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = Counter(vocabulary)
        for batch in by_bytes(batches, "text", BATCH):
            text = batch.column(1)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(_COUNTERS[vocabulary].count(text), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row, as the vocabulary's library counts without added tokens.

    Special strings inside texts count as the library's default has it. Null and empty texts have no bytes and no
    tokens; null ids and repeated rows pass through; other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_count(vocabulary)), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
