"""Packing by power-of-two decomposition: a document is cut into pieces of binary length, each a sequence of its own."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import known_id, pieces, prepare, with_known_id
from parchment.llm.tokens import default_tokenizer, encoder

LONGEST = 1024


def piece_lengths(total: int, longest: int = LONGEST) -> list[int]:
    """The pieces of total ids, longest first: whole ones of the longest length, then the set bits of the rest."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, with_ids: bool = False) -> DataFrame:
    """Sequences of documents (doc_id, text), a row each; no sequence crosses documents and none is padded.

    Columns: doc_id, start (ids of the document before the piece), length (a power of two up to longest), ids_crc32,
    doc_tokens (with the end id 0), sequence_id, offset (0: a piece opens its sequence), bucket (log2 of length; equal
    buckets make even batches), and ids (little-endian unsigned 32-bit) if with_ids. sequence_id holds the task in
    its high bits and a running number below, so it is unique without a shuffle. Null or empty text: one piece with
    the end id. Null doc_id stays null; repeated rows are packed one by one; an empty table gives no rows; other
    columns are ignored. No rows meet in a task, so there is nothing for a hot source or a group of copies to skew.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    names = ["known", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"] + ["ids"] * with_ids

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        coder = encoder(path)
        for batch in pieces(batches, rows=100):
            cols: list[list] = [[] for _ in names]
            for doc_id, known, ids in zip(batch["doc_id"].tolist(), batch["known"].tolist(), coder.encode([x or "" for x in batch["text"]])):
                ids, at = memoryview(ids + b"\0\0\0\0"), 0
                total = len(ids) // 4
                for n in piece_lengths(total, longest):
                    piece = ids[4 * at : 4 * (at + n)]
                    row = (known, doc_id, at, n, zlib.crc32(piece), total, number, 0, n.bit_length() - 1) + ((bytes(piece),) if with_ids else ())
                    for col, x in zip(cols, row):
                        col.append(x)
                    at, number = at + n, number + 1
            yield pd.DataFrame({k: np.array(v, dtype=np.int64) if k not in ("known", "ids") else v for k, v in zip(names, cols)})

    kinds = {"known": "boolean", "ids": "binary", "bucket": "int"}
    found = with_known_id(docs, F.col("text").cast("string").alias("text")).mapInPandas(cut, ", ".join(f"{k} {kinds.get(k, 'long')}" for k in names))
    return found.withColumn("doc_id", known_id()).drop("known")
