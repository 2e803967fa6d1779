"""A binary store of token ids: one frame for each document, a shared zstandard dictionary, an offset index.

Layout of a folder: ``dictionary-<sha256>.zdict`` and shard files. A shard holds consecutive documents in ascending
order of their id:

    header   magic "PDTOK1\\0\\0", sha256 of the dictionary (32 bytes), end of the frames (u64), documents (u64)
    frames   one zstandard frame for each document, ids as little-endian u16 (u32 where an id needs it)
    index    for each document: id (i64), offset (u64), bytes (u32), ids (u64), width of an id (u32)

A short document is read by its index entry alone: seek, read one frame, check the dictionary's hash, decompress.
Tasks write under a name of their own and the manifest holds the names that were committed, so a task that runs
twice after an executor was lost leaves a file that nobody reads.

Cases: a null text counts as empty and has the end id alone; rows with equal ids stay apart, in the order of
their text; null ids come first, written as the smallest long and read back as null; an empty table gives no file
and an empty result; other columns are not read. A very long text is a batch and a frame of its own.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from punchdeck.llm.common import by_bytes, cut, lean, near_hash, shared_folder, small_batches, text_or_empty
from punchdeck.llm.encoding import encoder, id_bytes, words

MAGIC = b"PDTOK1\0\0"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u8"), ("width", "<u4")])
HEAD = len(MAGIC) + 32 + 16
NULL_ID = -(1 << 63)
BATCH_BYTES = 2 << 20
#: Bytes of text in a shard, about: the number of files follows the corpus and no index outgrows a worker.
SHARD_BYTES = 24 << 20
MANIFEST = "shard long, file string, n_docs long, n_tokens long, n_bytes long, first_id long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _packed(ids: bytes) -> tuple[bytes, int]:
    wide = np.frombuffer(ids, "<u4")
    return (wide.astype("<u2").tobytes(), 2) if not len(wide) or wide.max() < 1 << 16 else (ids, 4)


def train(documents: DataFrame, tokenizer: str, end_id: int, samples: int = 1000, sample_bytes: int = 16_384, size: int = 65_536) -> tuple[bytes, int]:
    """Dictionary from the ids of ``samples`` documents of up to ``sample_bytes``, first by a hash: a fixed bound. Also the
    bytes of all texts, which the scan for the sample counts on its way."""
    n, seen = documents.count(), Observation()
    measured = documents.observe(seen, F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    short = measured.filter((F.octet_length("text") <= sample_bytes) & (F.octet_length("text") > 0))
    texts = [r.text for r in near_hash(short, samples, n, "id").select("text").collect()]
    return _trained(texts, tokenizer, end_id, size), seen.get["bytes"] or 0


def _trained(texts: list[str], tokenizer: str, end_id: int, size: int) -> bytes:
    import zstandard

    ids = [_packed(x + id_bytes([end_id]))[0] for x in encoder(tokenizer, words, id_bytes)(texts, b"".join)]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, ids)) // 8)), ids).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: the ids themselves serve as the dictionary's content
        return (b"".join(ids) or b"\0" * 8)[:size]


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", shards: int | None = None, level: int = 3, room: int = 1_000_000) -> DataFrame:
    """Writes the store and returns its manifest. One shuffle: a range partitioning by id.

    ``room``: encoded units that a worker remembers, about 200 bytes each.
    """
    import zstandard

    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("id"), text_or_empty(text_column).alias("text"))
    dictionary, n_bytes = train(rows, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).digest()
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/dictionary-{digest.hex()}.zdict") as f:
        f.write(dictionary)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        encode, end = encoder(tokenizer, words, id_bytes, room), id_bytes([end_id])
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        name, index, at, out = f"shard-{uuid.uuid4().hex}.pdtok", [], HEAD, None
        number = None
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            if out is None:
                out, number = files.open_output_stream(f"{root}/{name}.frames"), batch.column("shard")[0].as_py()
            for doc, made in zip(batch.column("id").to_pylist(), encode(batch.column("text").to_pylist(), b"".join), strict=True):
                ids, width = _packed(made + end)
                frame = pack.compress(ids)
                out.write(frame)
                index.append((doc, at, len(frame), len(ids) // width, width))
                at += len(frame)
        if out is None:
            return
        out.close()
        table = np.array(index, INDEX)
        with files.open_output_stream(f"{root}/{name}") as f:
            f.write(MAGIC + digest + np.array([at, len(table)], "<u8").tobytes())
            with files.open_input_stream(f"{root}/{name}.frames") as frames:
                while block := frames.read(1 << 20):
                    f.write(block)
            f.write(table.tobytes())
        files.delete_file(f"{root}/{name}.frames")
        row = {"shard": [number], "file": [name], "n_docs": [len(table)], "n_tokens": [int(table["ids"].sum())], "n_bytes": [at + table.nbytes], "first_id": [int(table["doc_id"][0])]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("first_id", pa.int64())]))

    n = shards or max(1, -(-n_bytes // SHARD_BYTES))
    dealt = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text").withColumn("shard", F.spark_partition_id().cast("long"))
    return cut(dealt.mapInArrow(lean(shard, keeps=True), MANIFEST))


class Shard:
    """Access to single documents of a shard."""

    def __init__(self, folder: str, name: str):
        import zstandard

        self.files, root = _open(folder)
        self.file = self.files.open_input_file(f"{root}/{name}")
        head = self.file.read_at(HEAD, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{name} is no shard")
        end, n = np.frombuffer(head[40:], "<u8")
        self.digest = head[8:40]
        with self.files.open_input_stream(f"{root}/dictionary-{self.digest.hex()}.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != self.digest:
            raise ValueError(f"{name}: the dictionary's hash differs")
        self.index = np.frombuffer(self.file.read_at(int(n) * INDEX.itemsize, int(end)), INDEX)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, k: int) -> np.ndarray:
        entry = self.index[k]
        data = self.unpack.decompress(self.file.read_at(int(entry["bytes"]), int(entry["offset"])))
        return np.frombuffer(data, f"<u{entry['width']}")


def read_digest(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files of the manifest.

    The window below runs over one row for each shard file, of ``SHARD_BYTES`` of text each.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, base in zip(frame["file"], frame["base"], strict=True):
                shard = Shard(folder, name)
                n = shard.index["ids"].astype(np.int64)
                crc = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(len(n))]
                ids = pd.array(shard.index["doc_id"], dtype="Int64")
                ids[shard.index["doc_id"] == NULL_ID] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": base + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc})

    shards = manifest.select("file", "first_id", "shard", before.alias("base"))
    n = max(1, manifest.count())
    return shards.repartition(n, "file").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
