"""Packing of tokenised documents into sequences by the sum-of-squares rule.

Each document ends with an end id. Only documents longer than a sequence are cut; the first piece takes the
remainder, so all later pieces fill a sequence of their own and one piece of each document is left to place.

The rule: a piece goes to the residual gap (or to a new sequence) after which the sum over gaps of the squared
number of open sequences is smallest. Pieces are dealt to shards by a hash of the document, each shard packs its
pieces with the longest first, and what a shard leaves badly filled is opened again and packed in a later round
over as many shards as the rest needs. The last round is the one of a single shard, or the one after a round that
settled less than half: pieces that fill no sequence well would not do so in any shard.

Cases: a null text counts as empty and is one piece with the end id alone; repeated rows are packed each for
itself; an empty table gives an empty result; other columns are not read. A very long text is a batch of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchdeck.llm.common import by_bytes, cut, lean, small_batches, text_or_empty
from punchdeck.llm.encoding import encoder, id_bytes, spaced_words

BATCH_BYTES = 2 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text", room: int = 600_000) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``, ``start`` counted in the document's own ids.

    ``room``: encoded units that a worker remembers, about 200 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = encoder(tokenizer, spaced_words, id_bytes, room), id_bytes([end_id]), 4
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            out: list[tuple] = []
            for doc, made in zip(batch.column("id").to_pylist(), encode(batch.column("text").to_pylist(), b"".join), strict=True):
                ids = made + end
                n = len(ids) // width
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[a * width : b * width])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(lean(run, keeps=True), PIECE)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each length in the order given, and how far each sequence is filled.

    With N(g) open sequences of gap g, moving one from g to g - s changes the sum of squares by
    2 (N(g - s) - N(g)) + 2, a new one by 2 N(capacity - s) + 1; full sequences are not counted. Ties go to the
    smaller gap, a new sequence comes last.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(counts[s:]) + s
        best, gap = 2 * (int(counts[capacity - s]) if s < capacity else 0) + 1, capacity
        if len(gaps):
            change = 2 * (counts[gaps - s] - counts[gaps]) + 2
            if gaps[0] == s:
                change[0] = 1 - 2 * counts[s]
            at = int(change.argmin())
            if change[at] <= best:
                gap = int(gaps[at])
        if gap == capacity:
            bin_ = len(filled)
            filled.append(0)
        else:
            bin_ = open_at[gap].pop()
            counts[gap] -= 1
        where[k], offset[k] = bin_, filled[bin_]
        filled[bin_] += s
        if left := gap - s:
            open_at[left].append(bin_)
            counts[left] += 1
    return where, offset, np.array(filled, np.int64)


def pack(items: DataFrame, capacity: int, shard_rows: int = 20_000, good: float = 0.995) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces``. ``shard_rows``: pieces that one task places, about."""
    schema = f"{PIECE}, sequence_id long, offset long"

    def place(last: bool, round_: int):
        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], ignore_index=True)
            where, offset, filled = sum_of_squares(frame["length"].to_numpy(), capacity)
            ids = (round_ << 56) | (int(key[0]) << 32) | where
            frame["sequence_id"] = ids if last else np.where(filled[where] >= good * capacity, ids, -1)
            frame["offset"] = offset
            return frame[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

        return run

    items = cut(items)
    full = items.filter(F.col("length") == capacity)
    left = items.filter(F.col("length") < capacity)
    n, before, round_, done = left.count(), None, 1, []
    while True:
        shards = max(1, -(-n // shard_rows))
        last = shards == 1 or before is not None and n > before // 2
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_)), F.lit(shards)))
        placed = dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(place(last, round_), schema)
        if last:
            done.append(placed)
            break
        placed = cut(placed)
        done.append(placed.filter("sequence_id >= 0"))
        left = placed.filter("sequence_id < 0").drop("sequence_id", "offset")
        n, before, round_ = left.count(), n, round_ + 1
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    for part in done:
        alone = alone.unionByName(part)
    return alone
