"""Token ids in ORC files, in ascending order of the documents' ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.encode import encoder
from marlstone.storage import new_path, stored

END_ID = 2
#: Text of one file, and rows that a task encodes at once.
FILE_BYTES, ROWS, FILES_EACH = 24_000_000, 200, 1_000
FILE_SCHEMA = "part int, row long, doc_id long, ids array<int>"
#: Stripes of 16 MB with an index entry for every 1,000 rows, and Bloom filters that a lookup by id can use.
ORC = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ids_column(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def crc_of(lists: pa.Array) -> list[int]:
    values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4")
    at = lists.offsets.to_numpy()
    return [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Writes part, row, doc_id and ids of every document, sorted by doc_id within and across files.

    The texts are dealt by ranges of (doc_id, hash of the text), so that rows of one id can spread; null ids
    come first, ties are ordered by the hash. Null text is empty and has its end id only.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    df = df.withColumn("h", F.xxhash64("text")).repartitionByRange(max(1, -(-size // file_bytes)), "doc_id", "h")

    def encode(batches):
        part, row, own = TaskContext.get().partitionId(), 0, encoder(tokenizer, spaced=True)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                texts = some.column(1).to_pylist()
                n = len(texts)
                ids = ids_column([np.append(x, np.uint32(end_id)) for x in own.encode_all(texts)])
                rows = pa.array(np.arange(row, row + n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), rows, some.column(0), ids], names=["part", "row", "doc_id", "ids"])
                row += n

    out = df.sortWithinPartitions("doc_id", "h").select("doc_id", "text").mapInArrow(encode, FILE_SCHEMA)
    out.write.options(**ORC).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """part, row, doc_id and ids; a filter on doc_id prunes files, stripes and row groups by their statistics."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def digest(batches):
        for b in batches:
            ids = b.column(3)
            n = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], n, pa.array(crc_of(ids), pa.int64())], names=["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    digests = stored(
        read_token_files(spark, path).mapInArrow(digest, "part int, row long, doc_id long, n_tokens long, ids_crc32 long"),
        "token-digests",
    )
    # Files are summed in blocks of FILES_EACH, blocks in blocks of blocks, so no task sees all files: with this many
    # levels there are FILES_EACH**3 files.
    files = digests.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.lit(0).cast("long"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    for level in range(3):
        each = FILES_EACH**level
        group, place = F.floor(F.col("part") / (each * FILES_EACH)), F.floor(F.col("part") / each)
        sums = files.groupBy(group.alias("above"), place.alias("at")).agg(F.sum("n").alias("m"))
        sums = sums.withColumn("more", F.coalesce(F.sum("m").over(before(Window.partitionBy("above").orderBy("at"))), F.lit(0)))
        files = files.withColumn("at", place).join(sums.select("at", "more"), "at").select("part", "n", (F.col("base") + F.col("more")).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("row"))), F.lit(0))
    return digests.withColumn("inside", inside).join(files, "part").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_offsets(spark, path)
