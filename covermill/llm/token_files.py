"""Token-id files: each document's ids compressed for itself with a shared zstandard dictionary.

Layout of a token folder, written and read with Spark's own Parquet files, so that any store that
Spark reaches will do:

* ``dictionary``: one row, the zstandard dictionary and its SHA-256;
* ``blocks``: one row per block of documents in ascending order of ``doc_id``: the block's part and
  number, the number of ids before it in its part, the dictionary's hash, the width of an id in
  bytes, then the index (``doc_ids``, ``lengths`` in ids, ``offsets`` in bytes) and ``payload``, the
  documents' frames one after another;
* ``parts``: one row per part, with the number of ids in all parts before it.

A document is read by its block's index alone: one slice of the payload is decompressed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covermill.llm.library_tokens import library_encoder, tokenizer_path
from covermill.llm.pieces import slices_by_bytes
from covermill.llm.sampling import bounded_sample
from covermill.session import shared_dir

VOCABULARY = "byte_bpe_50k.json"
#: The dictionary is trained on the ids of this many documents, the first of an order by hash, and on so many ids of each.
SAMPLE_DOCUMENTS, SAMPLE_IDS = 1_000, 4_096
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES, BLOCK_DOCUMENTS = 1 << 20, 4_096
#: Bytes of ids that a reading task gives back at once, more for a document that is larger.
READ_BYTES = 4 << 20

_BLOCKS = (
    "part int, block int, start_in_part long, n_tokens long, first_id long, last_id long, dictionary_hash string, width int, "
    "doc_ids array<long>, lengths array<int>, offsets array<int>, payload binary"
)
_SCHEMA = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
    ("dictionary_hash", pa.string()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("payload", pa.binary()),
])


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for serialized ids; of too few samples, the samples themselves; of none, empty."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(docs: DataFrame, vocabulary: str) -> DataFrame:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path(vocabulary))
        width = encoder.dtype.itemsize
        samples = [x[: SAMPLE_IDS * width] for batch in batches for part in slices_by_bytes(batch.column(0)) for x in encoder.encode(part.to_pylist()) if x]
        data = train_dictionary(samples)
        yield pa.RecordBatch.from_pydict({"dictionary": [data], "dictionary_hash": [hashlib.sha256(data).hexdigest()]}, pa.schema([("dictionary", pa.binary()), ("dictionary_hash", pa.string())]))

    sample = bounded_sample(docs.select("doc_id", "text"), ["doc_id", "text"], SAMPLE_DOCUMENTS)
    return sample.select("text").coalesce(1).mapInArrow(train, "dictionary binary, dictionary_hash string")


def _write_blocks(dictionary: bytes, dictionary_hash: str, vocabulary: str, end_id: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path(vocabulary))
        width = encoder.dtype.itemsize
        end = b"" if end_id is None else np.array([end_id], dtype=encoder.dtype).tobytes()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=3, dict_data=shared).compress
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        lengths: list = []
        offsets: list = []
        frames: list = []
        size = 0

        def close() -> pa.RecordBatch:
            n = sum(lengths)
            row = [part, block, before, n, ids[0], ids[-1], dictionary_hash, width, list(ids), list(lengths), list(offsets), b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            at = 0
            for texts in slices_by_bytes(batch.column(1)):
                for data in encoder.encode(texts.to_pylist()):
                    data += end
                    frame = compress(data)
                    if ids and (size + len(frame) > BLOCK_BYTES or len(ids) >= BLOCK_DOCUMENTS):
                        yield close()
                        block, before = block + 1, before + sum(lengths)
                        ids, lengths, offsets, frames, size = [], [], [], [], 0
                    ids.append(batch.column(0)[at].as_py())
                    lengths.append(len(data) // width)
                    offsets.append(size)
                    frames.append(frame)
                    size += len(frame)
                    at += 1
        if ids:
            yield close()

    return write


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int | None = 0) -> str:
    """Writes the ids of every whole text in ascending order of ``doc_id`` and returns ``path``.

    Takes ``doc_id`` and ``text``, other columns are ignored. A null text counts as empty; every
    document ends with ``end_id`` unless that is None. Null ids come first; rows that share an id are
    ordered by their text's hash. An empty table gives a folder without blocks. Rows are dealt by
    ranges of id and hash, so that an id that repeats is spread too.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    _dictionary(docs, vocabulary).write.mode("overwrite").parquet(f"{path}/dictionary")
    rows = spark.read.parquet(f"{path}/dictionary").collect()
    dictionary, dictionary_hash = (bytes(rows[0][0]), rows[0][1]) if rows else (b"", "")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ordered.select("doc_id", "text").mapInArrow(_write_blocks(dictionary, dictionary_hash, vocabulary, end_id), _BLOCKS)
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    # one row per part: a number of tasks, not of documents
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", before.alias("start")).write.mode("overwrite").parquet(f"{path}/parts")
    return path


def _frames(dictionary: bytes, limit: int = READ_BYTES):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        decompress = zstandard.ZstdDecompressor(dict_data=shared).decompress
        types, names = (pa.int64(), pa.int64(), pa.int64(), pa.binary()), ["doc_id", "start", "n_tokens", "ids"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

        # a block of texts that repeat themselves is many times larger when it is decompressed
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.slice(at, 1).to_pylist()[0]
                payload, wanted, start = memoryview(block["payload"]), block["wanted"], block["start"]
                bounds = [*block["offsets"], len(payload)]
                rows: list[tuple] = []
                size = 0
                for i, (doc_id, n) in enumerate(zip(block["doc_ids"], block["lengths"], strict=True)):
                    if wanted is None or doc_id in wanted:
                        data = decompress(payload[bounds[i] : bounds[i + 1]])
                        ids = np.frombuffer(data, dtype=f"<u{block['width']}").astype("<u4").tobytes()
                        if rows and size + len(ids) > limit:
                            yield batch_of(rows)
                            rows, size = [], 0
                        rows.append((doc_id, start, n, ids))
                        size += len(ids)
                    start += n
                yield batch_of(rows)

    return read


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` as little-endian unsigned 32-bit integers.

    With ``doc_ids`` only blocks whose range of ids can hold one of them are read, and only the
    wanted documents are decompressed.
    """
    rows = spark.read.parquet(f"{path}/dictionary").collect()
    dictionary, expected = (bytes(rows[0][0]), rows[0][1]) if rows else (b"", "")
    if rows and hashlib.sha256(dictionary).hexdigest() != expected:
        raise ValueError("the dictionary doesn't match its hash")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    if doc_ids is not None:
        near = F.lit(False)
        for x in doc_ids:
            near = near | F.lit(x).between(F.col("first_id"), F.col("last_id"))
        blocks = blocks.where(near)
    wanted = F.lit(None).cast("array<long>") if doc_ids is None else F.array(*map(F.lit, doc_ids)).cast("array<long>")
    same = F.when(F.col("dictionary_hash") == expected, F.col("payload")).otherwise(F.raise_error(F.lit("a block was written with another dictionary")))
    parts = spark.read.schema("part int, start long").parquet(f"{path}/parts")
    located = blocks.join(parts, "part").select((F.col("start") + F.col("start_in_part")).alias("start"), "width", "doc_ids", "lengths", "offsets", same.alias("payload"), wanted.alias("wanted"))
    return located.mapInArrow(_frames(dictionary), "doc_id long, start long, n_tokens long, ids binary")


_LISTED: list[list[str]] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own below the shared one, for one run."""
    folder = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    for made in _LISTED:
        made.append(folder)
    return folder


@contextmanager
def folders_removed(spark: SparkSession) -> Iterator[None]:
    """Removes the folders that ``new_folder`` gave inside; for work whose result is written before the end."""
    made: list[str] = []
    _LISTED.append(made)
    try:
        yield
    finally:
        _LISTED.remove(made)
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
