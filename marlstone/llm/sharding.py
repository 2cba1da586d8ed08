"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.storage import stored

#: The ring has 2**CELL_BITS positions; ranks within a position are taken in 2**SUB_BITS parts.
CELL_BITS, SUB_BITS = 12, 6


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise."""

    def at(shard: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{shard}#{v}".encode(), digest_size=8).digest(), "big")

    points = sorted((at(s, v), s) for s in range(n_shards) for v in range(vnodes))
    return [(p >> (64 - CELL_BITS), s) for p, s in points]


def place(counts: dict[int, int], n_shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first rank) for all rows of all cells.

    A key belongs to the first virtual node at or after its cell. Each shard first takes keys of its own
    cells, clockwise, until it is full; keys of full shards then continue clockwise to the next virtual
    node whose shard has room. The capacities differ by one at most and add up to the number of rows, so
    every shard ends exactly full. The input is one count for each ring position, so it never grows.
    """
    nodes = ring(n_shards, vnodes)
    cells = [c for c, _ in nodes]
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    out, over = [], []

    def take(cell: int, lo: int, hi: int, shard: int) -> int:
        k = min(hi - lo, room[shard])
        if k:
            out.append((cell, lo, lo + k, shard, used[shard]))
            used[shard] += k
            room[shard] -= k
        return lo + k

    for cell in sorted(counts):
        home = bisect_left(cells, cell) % len(nodes)
        lo = take(cell, 0, counts[cell], nodes[home][1])
        if lo < counts[cell]:
            over.append((cell, lo, counts[cell], home))
    for cell, lo, hi, at in over:
        while lo < hi:
            at = (at + 1) % len(nodes)
            lo = take(cell, lo, hi, nodes[at][1])
    return out


def bounded_ring_shards(docs: DataFrame, n_shards: int = 24, vnodes: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; shards' counts are at most one apart.

    The key on the ring hashes doc_id with the text's checksum, so repeated ids with different texts
    spread; equal texts under different ids spread too. Ranks at a ring position come from counts of its
    parts plus a row number in each part: no task sees more than one part. Null text has size 8 and the
    checksum of the empty text; null doc_id is a key of its own; an empty table gives no rows.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32"))
    keyed = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")).withColumn("h", key)
    keyed = stored(
        keyed.withColumns(
            {
                "cell": F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int"),
                "sub": F.shiftrightunsigned("h", 64 - CELL_BITS - SUB_BITS).bitwiseAND((1 << SUB_BITS) - 1).cast("int"),
            }
        ),
        "ring-keys",
    )
    parts = keyed.groupBy("cell", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["cell"]: r["n"] for r in keyed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    rows = [dict(zip(("cell", "lo", "hi", "shard", "slot0"), x, strict=True)) for x in place(counts, n_shards, vnodes)]
    kind = "array<struct<cell:int,lo:bigint,hi:bigint,shard:int,slot0:bigint>>"
    segments = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))
    rank = Window.partitionBy("cell", "sub").orderBy("h", "doc_id", "size")
    # Both tables are bounded by the ring: 2**18 parts, and a segment or a few for each of 4,096 positions.
    ranked = keyed.withColumn("r", F.row_number().over(rank) - 1).join(F.broadcast(parts), ["cell", "sub"])
    ranked = ranked.withColumn("r", F.col("r") + F.col("base"))
    seg = segments.withColumnRenamed("cell", "seg_cell")
    inside = (F.col("cell") == F.col("seg_cell")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))
    return ranked.join(F.broadcast(seg), inside).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("r") - F.col("lo")).alias("slot")
    )


def op8_ring_shards(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    out = bounded_ring_shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
