"""Token ids in fixed-width bit packing: files that NumPy unpacks at once and reads from at any place.

Format: a Parquet data set with one row per block, so that any file system Spark writes to will do, and a task
that is repeated leaves one copy. A block holds whole documents, closed at ``BLOCK_IDS`` ids or more:

    shard, block         files in ascending document order: by shard, then by block
    start                ids of the shard before this block
    first_doc, last_doc  for finding a document by the files' statistics
    doc_ids, doc_starts  the documents of the block and the place of each one's first id, plus the end
    bits                 width: the fewest bits that hold the largest id of the vocabulary
    payload              id i at bits [i * bits, (i + 1) * bits), least significant bit first

Each document ends with ``end_id``. Documents stand in ascending order of id, NULL ids first, repeated ids by a
hash of the text, so that reruns agree. A NULL text counts as empty. Other columns are ignored; an empty table gives no
block. Sorting shuffles the texts once; tasks hold one batch of texts and one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaflow.llm.encoding import encoder, text_groups
from mediaflow.shipping import ship_package

BLOCK_IDS = 1 << 17

BLOCK_SCHEMA = (
    "shard int, block int, start bigint, first_doc bigint, last_doc bigint, "
    "doc_ids array<bigint>, doc_starts array<bigint>, bits int, payload binary"
)


def width(vocabulary: int) -> int:
    """Fewest bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = np.arange(bits, dtype=np.uint32)
    return np.packbits((ids.astype(np.uint32)[:, None] >> places) & 1, bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, stop: int) -> np.ndarray:
    """Ids ``first`` to ``stop`` of a block; only their bytes are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}")[first:stop].astype(np.uint32)
    begin = first * bits // 8
    part = np.frombuffer(payload, np.uint8)[begin : (stop * bits + 7) // 8]
    loose = np.unpackbits(part, bitorder="little")[first * bits - 8 * begin :][: (stop - first) * bits]
    places = np.arange(bits, dtype=np.uint32)
    return (loose.reshape(-1, bits).astype(np.uint32) << places).sum(axis=1, dtype=np.uint32)


def write_tokens(
    documents: DataFrame, path: str, tokenizer: str, vocabulary: int, id_col: str, text_col: str, end_id: int = 0
) -> None:
    """Encode every text and write the blocks to ``path``."""
    spark = documents.sparkSession
    ship_package(spark)
    bits = width(vocabulary)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer) as loaded:
            yield from packed(batches, loaded.encode)

    def packed(batches: Iterator[pa.RecordBatch], encode) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        names: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = start = number = 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            row = [shard, number, start, names[0], names[-1], list(names), starts.tolist(), bits, pack(ids, bits)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([value], kind) for value, kind in zip(row, types)],
                ["shard", "block", "start", "first_doc", "last_doc", "doc_ids", "doc_starts", "bits", "payload"],
            )

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in text_groups(batch.column(1).to_pylist(), 1 << 19):
                ids, n, _ = encode(texts)
                ends = np.cumsum(n)
                whole = np.insert(ids, ends, end_id)
                names += keys[first : first + len(texts)]
                held.append(whole)
                counts.append(n + 1)
                size += len(whole)
                if size >= BLOCK_IDS:
                    yield closed()
                    start, number = start + size, number + 1
                    names, held, counts, size = [], [], [], 0
        if names:
            yield closed()

    (
        documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", F.xxhash64("text"))
        .mapInArrow(blocks, BLOCK_SCHEMA)
        .write.mode("error")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files alone."""
    ship_package(spark)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.select("shard", F.element_at("doc_starts", -1).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # One row per file: bounded by the partitions of the write, not by the documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["doc_starts"][-1]).astype("<u4")
                starts = np.array(row["doc_starts"], np.int64)
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts[:-1] + row["start"] + row["offset"]),
                        pa.array(np.diff(starts)),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.join(F.broadcast(offsets), "shard").mapInArrow(
        documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def document_ids(blocks: DataFrame, doc_id: int) -> np.ndarray:
    """The ids of one document: its block is found by the files' statistics, and only its bytes are unpacked."""
    from_it = F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id)  # NULL ids come first
    near = blocks.filter(from_it & (F.col("last_doc") >= doc_id))
    hit = near.select("doc_ids", "doc_starts", "bits", "payload").filter(F.array_contains("doc_ids", doc_id)).first()
    if hit is None:
        raise KeyError(doc_id)
    i = hit["doc_ids"].index(doc_id)
    return unpack(hit["payload"], hit["bits"], hit["doc_starts"][i], hit["doc_starts"][i + 1])
