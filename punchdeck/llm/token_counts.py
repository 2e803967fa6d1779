"""Token counts of whole texts: batch encoding in an Arrow function that returns lengths only.

Cases: a null text counts as empty (0 bytes, 0 tokens); empty texts have 0 tokens; repeated rows are counted each
for itself; an empty table gives an empty result. Columns besides ``id_column`` and ``text_column`` are not read.
A very long text is a batch of its own and is encoded in units, none of which a pattern crosses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchdeck.llm.common import by_bytes, lean, small_batches, text_or_empty
from punchdeck.llm.encoding import encoder, words

BATCH_BYTES = 2 << 20


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each row, in one narrow stage without a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, words, len)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            texts = batch.column("text")
            n = encode(texts.to_pylist(), sum)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(lean(count, keeps=True), f"`{id_column}` long, n_bytes long, n_tokens long, over_limit boolean")
