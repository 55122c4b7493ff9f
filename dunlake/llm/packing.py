"""Best-fit packing planned on a histogram of lengths; documents take planned slots by rank within their length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunlake.llm.bpe import tokenizer
from dunlake.llm.common import rows, shuffle_partitions, slices, small_batches, stored, texts, tidied

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Text that is tokenized at once: unknown words are encoded together, but arrays take about 40 bytes a byte.
TOKEN_SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch of texts. Only a slice is tokenized at once, so a batch of Spark's 64 MB would be held for nothing.
BATCH_BYTES = 1 << 22
#: Shuffle partitions for each file of the stored pieces, which take a small part of their texts' bytes.
PARTITIONS_A_FILE = 16
#: The result has a task for so many pieces, or one for each shuffle partition if those are fewer.
TASK_PIECES = 1 << 15

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def pieces(docs: DataFrame, vocabulary: str, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Token pieces of all documents: (doc_id, piece, start, length, ids_crc32).

    A document is its ids and a final 0. One of more than ``size`` ids is cut so that only its first piece is shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        for batch in batches:
            done = 0
            for part in slices(batch, TOKEN_SLICE_BYTES):
                ids, bounds = coder.encode(part)
                n = len(part)
                whole = np.insert(ids.astype("<u4"), bounds[1:], END_ID)
                bounds = bounds + np.arange(n + 1)
                total = np.diff(bounds)
                count = -(-total // size)
                owner = np.repeat(np.arange(n), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                first = total - (count - 1) * size
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * size)
                length = np.where(piece == 0, first[owner], size)
                at = bounds[owner] + start
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                doc_ids = batch.column("id").slice(done, n).take(pa.array(owner))
                done += n
                yield rows(_PIECES, [doc_ids, piece.astype(np.int32), start, length, crc])

    return texts(docs).mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], size: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: rows (length, first rank, count, first sequence, offset).

    The pieces of a length with ranks first..first+count-1 go to as many consecutive sequences, all at the same offset.
    Alike sequences are planned together, so the work depends on the number of lengths and not on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # space left: groups of (first sequence, count)
    spaces: list[int] = []
    slots, sequences = [], 0

    def leave(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in room:
                room[space] = []
                insort(spaces, space)
            room[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = room[space].pop()
                if not room[space]:
                    del room[space]
                    spaces.pop(at)
            else:
                space, first, count = size, sequences, -(-left // (size // length))
                sequences += count
            each = space // length
            full = min(count, left // each)
            if full:
                for k in range(each):
                    slots.append((length, rank, full, first, size - space + k * length))
                    rank += full
                left -= full * each
                leave(space - each * length, first, full)
            if full < count:
                rest = left if left < each else 0
                for k in range(rest):
                    slots.append((length, rank, 1, first + full, size - space + k * length))
                    rank += 1
                left -= rest
                if rest:
                    leave(space - rest * length, first + full, 1)
                    leave(space, first + full + 1, count - full - 1)
                else:
                    leave(space, first + full, count - full)
    return slots


def pack(docs: DataFrame, vocabulary: str, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pack all documents into sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null text is empty, so its document is the final id alone. Null ids, repeated rows and other columns are taken as
    they are: every row of ``docs`` gives its own pieces. An empty table gives no rows.

    Pieces are tokenized once and stored. The driver sees one count a length (``size`` at most) and plans; the plan has
    no row per document. A piece's rank within its length is its place in its bucket of ids plus the counts of earlier
    buckets, so a length that holds most pieces is ranked by many tasks.

    Rows are few bytes each, so both the stored pieces and the result are gathered into few tasks. Every file costs work
    beyond its bytes; a local folder has its rights set by processes that the executor starts.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    found = pieces(docs, vocabulary, size).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    with small_batches(spark, BATCH_BYTES):
        cut = stored(found.repartition(-(-buckets // PARTITIONS_A_FILE)), "pieces")
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    slots = spark.createDataFrame(
        pa.table(
            [pa.array(c, pa.int64()) for c in (zip(*plan(histogram, size), strict=True) if histogram else [[]] * 5)],
            names=["slot_length", "slot_rank", "slot_count", "first_sequence", "offset"],
        )
    )
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = cut.withColumn("local", F.row_number().over(local) - 1).join(before, ["length", "bucket"])
    rank = F.col("before") + F.col("local")
    fits = (F.col("length") == F.col("slot_length")) & (rank >= F.col("slot_rank")) & (rank < F.col("slot_rank") + F.col("slot_count"))
    # The plan's size is bounded by the lengths there are, whatever the number of documents.
    placed = ranked.join(F.broadcast(slots), fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + rank - F.col("slot_rank")).alias("sequence_id"), "offset"
    )
    return placed.coalesce(max(1, -(-sum(histogram.values()) // TASK_PIECES)))
