"""Token ids in files: frequency-ranked ids, byte-aligned variable length, control bytes kept apart.

An id is replaced by its rank by frequency over all documents, so common ids take one byte. Ranks are
written with 1 to 4 data bytes each; two bits per rank tell how many, four ranks to a control byte.
Readers look the control bytes up in a table of lengths and gather the data bytes with numpy.

On disk ``blocks`` is a Parquet table with one folder per shard; shards, and the blocks of a shard, are in
ascending order of the document id. A block holds the control bytes and the data bytes of its documents as
two binary columns, the documents' ids and lengths, and the number of ids in front of it in its shard.
``vocabulary`` holds (rank, id, number), ``shards`` the number of ids in front of each shard.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from labelloom.llm.common import _slices, bounded_batches, reachable
from labelloom.llm.encoder import encoder
from labelloom.operators.scale import checkpoint_folder, materialize

BLOCK_IDS = 1 << 17

# Data bytes of the four ranks that a control byte stands for, and all of them together.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = codes
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    wanted = np.arange(4, dtype=np.uint8) <= codes[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[wanted]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks that ``encode_ranks`` wrote."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    values = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = values[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= values[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, path: str, end_id: int, key: str, text: str) -> DataFrame:
    """(key, shard, first, n, ids, counts): the ids of every document in ascending order of the key, written once.

    Ids take two bytes where the vocabulary allows it, else four. Some rows carry ``counts``: the distinct ids of
    the documents up to the next such row, and how often each occurs.
    """
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("shard", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(path, spaced=False)
        shard, before = TaskContext.get().partitionId(), 0
        width = np.dtype("<u2" if len(encode.size) <= 1 << 16 else "<u4")
        for batch in batches:
            for part in _slices(batch, "_text"):
                ids = encode.ids(part.column("_text")).ended(end_id)
                n = ids.sizes
                first = before + ids.offsets[:-1]
                before += len(ids.values)
                ends = pa.py_buffer((width.itemsize * ids.offsets).astype(np.int32))
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(ids.values.astype(width))])
                found = np.bincount(ids.values)
                used = np.flatnonzero(found)
                counts = [np.stack([used, found[used]]).tobytes(), *[None] * (len(n) - 1)]
                columns = [
                    part.column(key), pa.array(np.full(len(n), shard, dtype=np.int32)), pa.array(first), pa.array(n), data,
                    pa.array(counts, type=pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = docs.select(key, F.col(text).cast("string").alias("_text"))
    tie = F.xxhash64("_text")
    ordered = rows.repartitionByRange(key, tie).sortWithinPartitions(key, tie)
    return materialize(ordered.mapInArrow(run, schema), "token-ids")


def frequencies(ids: DataFrame) -> DataFrame:
    """(id, number) over all documents, from the counts that were written with the ids."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                used, found = np.frombuffer(counts, dtype=np.int64).reshape(2, -1)
                if used[-1] >= len(total):
                    total = np.pad(total, (0, int(used[-1]) + 1 - len(total)))
                total[used] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "number"])

    counted = ids.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, number long")
    return counted.groupBy("id").agg(F.sum("number").alias("number"))


def write_ids(
    docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> None:
    """Write the ids of every row's whole text, each followed by ``end_id``, in ascending key order.

    The vocabulary bounds the table of ranks (one row per id of the tokenizer), which is the only thing
    that reaches the driver and every task. Texts are tokenised once; the ids are kept in the shared
    folder until their frequencies are known.
    """
    spark = docs.sparkSession
    ids = tokenised(docs, path, end_id, key, text)
    table = frequencies(ids).orderBy(F.desc("number"), "id").collect()
    vocabulary = np.array([r["id"] for r in table], dtype=np.int64)
    rank_of = np.zeros(int(vocabulary.max()) + 1 if len(vocabulary) else 1, dtype="<u4")
    rank_of[vocabulary] = np.arange(len(vocabulary))
    ranked = [(k, int(r["id"]), int(r["number"])) for k, r in enumerate(table)]
    spark.createDataFrame(ranked, "rank long, id long, number long").coalesce(1).write.parquet(f"{folder}/vocabulary")
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("keys", T.ArrayType(ids.schema[key].dataType)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("control", T.BinaryType()),
            T.StructField("data", T.BinaryType()),
        ]
    )

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def block(shard, first, keys, lengths, parts):
            joined = b"".join(parts)
            control, data = encode_ranks(rank_of[np.frombuffer(joined, dtype=f"<u{len(joined) // sum(lengths)}")])
            values = [[shard], [first], [keys], [lengths], [control], [data]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, type=f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow
            )

        current, held = None, 0
        for batch in batches:
            rows = zip(
                *(batch.column(c).to_pylist() for c in (key, "shard", "first", "n")), batch.column("ids"), strict=True
            )
            for row_key, shard, first, n, data in rows:
                if current and (current[0] != shard or current[1] + held != first or held >= BLOCK_IDS):
                    yield block(*current)
                    current = None
                if current is None:
                    current, held = (shard, first, [], [], []), 0
                current[2].append(row_key)
                current[3].append(n)
                current[4].append(data.as_buffer())
                held += n
        if current:
            yield block(*current)

    ids.drop("counts").mapInArrow(run, schema).write.partitionBy("shard").parquet(f"{folder}/blocks")
    sizes = ids.groupBy("shard").agg(F.sum("n").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("shard", "ids", before.alias("before")).coalesce(1).write.parquet(f"{folder}/shards")


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    vocabulary = np.array(
        [r["id"] for r in spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()], dtype="<u4"
    )
    columns = f"first long, keys array<{key_type}>, lengths array<long>, control binary, data binary, shard int"
    blocks = spark.read.schema(columns).parquet(f"{folder}/blocks")
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "before")
    kind = blocks.schema["keys"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                first, keys, lengths, control, data = (batch.column(j)[i].as_py() for j in range(5))
                before = batch.column(5)[i].as_py()
                n = np.array(lengths, dtype=np.int64)
                ends = np.cumsum(n)
                ids = vocabulary[decode_ranks(control, data, int(ends[-1]))]
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths, strict=True)]
                columns = [keys, before + first + ends - n, n, crc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return blocks.join(shards, "shard").select("first", "keys", "lengths", "control", "data", "before").mapInArrow(
        run, schema
    )


def encode_corpus(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all documents to new files in the shared folder and read them back.

    (key, start, n_tokens, ids_crc32): ``start`` counts the ids of all documents before, ``n_tokens`` and
    the unsigned crc32 of the ids as little-endian 32-bit integers include the end id. A null or empty
    text is the end id alone. Null keys come first; rows of one key are in the order of a hash of their
    text, equal rows in any order, which makes no difference. Other columns are not read; an empty table
    gives empty files and no rows.
    """
    reachable(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    folder = f"{checkpoint_folder(docs.sparkSession)}/id-files-{uuid.uuid4().hex}"
    write_ids(docs, folder, path, end_id, key, text)
    return read_ids(docs.sparkSession, folder, key, docs.schema[key].dataType.simpleString())
