"""Encoding and decoding of documents with a byte-level BPE vocabulary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.llm.bpe import byte_table, tokenizer
from dunlake.llm.common import rows, ship_package, slices, texts, tidied
from dunlake.llm.packing import TOKEN_SLICE_BYTES

_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Token ids of every whole text: (doc_id, ids), one row per row of ``docs``.

    Null and empty text has no ids. Special tokens of the vocabulary are found in the text; none are added. Null ids,
    repeated rows and other columns are taken as they are. Tasks hold one slice of text and a bounded cache of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        for batch in batches:
            done = 0
            for part in slices(batch, TOKEN_SLICE_BYTES):
                ids, bounds = coder.encode(part)
                doc_ids = batch.column("id").slice(done, len(part))
                done += len(part)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield rows(_ENCODED, [doc_ids, lists])

    return texts(docs).mapInArrow(tidied(run), "doc_id long, ids array<int>")


_DECODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("text", pa.string())])


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Text of every row of (doc_id, ids): (doc_id, n_tokens, ids_sha256, text).

    Null ids give an empty text; bytes that are no UTF-8 become U+FFFD. The digest is of the ids as little-endian
    unsigned 32-bit numbers, so that a stored text can be told to be that of stored ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(vocabulary)
        for batch in batches:
            column = batch.column("ids")
            flat = column.values.to_numpy(zero_copy_only=False).astype("<u4")
            bounds = column.offsets.to_numpy()
            for low in range(0, len(column), 1000):
                high = min(low + 1000, len(column))
                lists = [flat[a:b] for a, b in zip(bounds[low:high].tolist(), bounds[low + 1 : high + 1].tolist(), strict=True)]
                said = [b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace") for ids in lists]
                digests = [hashlib.sha256(ids.tobytes()).hexdigest() for ids in lists]
                yield rows(_DECODED, [batch.column("doc_id").slice(low, high - low), [len(ids) for ids in lists], digests, said])

    ship_package(encoded)
    filled = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return filled.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, text string")
