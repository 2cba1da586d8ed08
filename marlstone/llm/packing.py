"""Documents packed into sequences of a fixed length."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.encode import encoder
from marlstone.llm.token_files import crc_of, ids_column, tokenizer_path
from marlstone.storage import stored

LENGTH, END_ID = 4096, 1
#: Pieces that one task packs; bins with at most SLACK free tokens are done in a round, the others meet in the next.
GROUP, SLACK, ROUNDS = 10_000, 4, 6
ROWS = 200
PIECES = "doc_id long, piece int, start long, length long, ids array<int>"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """The token ids of every document with its end id, in pieces of at most length tokens; pid names a piece."""

    def encode(batches):
        tokens = encoder(tokenizer, spaced=False)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                out = [[], [], [], [], []]
                for doc_id, own in zip(some.column(0).to_pylist(), tokens.encode_all(some.column(1).to_pylist()), strict=True):
                    ids = np.append(own, np.uint32(end_id))
                    for i, start in enumerate(range(0, len(ids), length)):
                        own = ids[start : start + length]
                        for x, v in zip(out, (doc_id, i, start, len(own), own), strict=True):
                            x.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                columns = [pa.array(x, k) for x, k in zip(out, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, ids_column(out[4])], names=["doc_id", "piece", "start", "length", "ids"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return stored(texts.mapInArrow(encode, PIECES).withColumn("pid", F.monotonically_increasing_id()), "pieces")


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Bins of items, longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    free: list[int] = []  # distinct free sizes, sorted
    at: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        j = bisect_left(free, sizes[i])
        if j == len(free):
            b, room = len(bins), cap
            bins.append([])
        else:
            room = free[j]
            b = at[room].pop()
            if not at[room]:
                del free[j]
        bins[b].append(i)
        room -= sizes[i]
        if not at[room]:
            insort(free, room)
        at[room].append(b)
    return bins


def improve(bins: list[list[int]], sizes: list[int], cap: int, most_steps: int = 20_000) -> list[list[int]]:
    """Moves and exchanges that raise the sum of squared fills, until no bin can be emptied or the bound is met.

    The emptiest bin gives items to fuller ones: an item that fits; one for a shorter one; two for a shorter
    one. Every step makes a fuller bin fuller, so the squares grow and the search ends.
    """
    least = -(-sum(sizes) // cap)
    done = [b for b in bins if sum(sizes[i] for i in b) == cap]
    work = [list(b) for b in bins if sum(sizes[i] for i in b) < cap]
    fill = [sum(sizes[i] for i in b) for b in work]
    steps = 0

    def give(a: int, b: int, out: list[int], back: list[int]) -> None:
        for i in out:
            work[a].remove(i)
            work[b].append(i)
        for i in back:
            work[b].remove(i)
            work[a].append(i)
        moved = sum(sizes[i] for i in out) - sum(sizes[i] for i in back)
        fill[a] -= moved
        fill[b] += moved

    def step(a: int) -> bool:
        others = sorted((b for b in range(len(work)) if b != a and work[b] and fill[b] >= fill[a]), key=lambda b: -fill[b])
        mine = sorted(work[a], key=lambda i: -sizes[i])
        for i in mine:
            for b in others:
                if fill[b] + sizes[i] <= cap:
                    give(a, b, [i], [])
                    return True
        pairs = [(i,) for i in mine] + [(i, j) for x, i in enumerate(mine[:40]) for j in mine[x + 1 : 40]]
        for b in others:
            room, theirs = cap - fill[b], sorted(work[b], key=lambda i: sizes[i])
            if not room:
                continue
            lengths = [sizes[i] for i in theirs]
            best = (0, None, None)
            for out in pairs:
                x = sum(sizes[i] for i in out)
                k = bisect_left(lengths, x - room)
                if k < len(lengths) and lengths[k] < x and x - lengths[k] > best[0]:
                    best = (x - lengths[k], out, theirs[k])
            if best[0]:
                give(a, b, list(best[1]), [best[2]])
                return True
        return False

    while len(done) + sum(1 for b in work if b) > least and steps < most_steps:
        order = sorted((a for a in range(len(work)) if work[a]), key=lambda a: fill[a])[:8]
        moved = next((a for a in order if step(a)), None)
        if moved is None:
            break
        steps += 1
    return done + [b for b in work if b]


def pack_group(pids: list[int], sizes: list[int], cap: int, first: int, last: bool, slack: int = SLACK):
    """(pid, sequence_id or None, offset) of every item; items of bins with more free room stay open unless last."""
    out = []
    for n, b in enumerate(improve(best_fit(sizes, cap), sizes, cap)):
        closed = last or cap - sum(sizes[i] for i in b) <= slack
        offset = 0
        for i in b:
            out.append((pids[i], first + n if closed else None, offset, sizes[i]))
            offset += sizes[i]
    return out


def packer(cap: int, turn: int, last: bool):
    """Packs the pieces of a group; its bins are named by round, group and number."""

    def pack(key, table):
        first = (turn << 56) + (key[0].as_py() << 24)
        rows = pack_group(table["pid"].to_pylist(), table["length"].to_pylist(), cap, first, last)
        return pa.table([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["pid", "sequence_id", "offset", "length"])

    return pack


def plan(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """pid, sequence_id and offset of every piece: local search in groups of bounded size.

    Whole pieces fill a sequence each. The others are packed in groups of about GROUP, by a hash; bins with
    free room go back, and their pieces meet those of other groups in the next round, until one group holds
    what is left or a round closes little more.
    """
    lengths = pieces.select("pid", "length")
    whole = lengths.filter(F.col("length") == length).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    found, rest = [whole], lengths.filter(F.col("length") < length)
    left = rest.count()
    for turn in range(ROUNDS):
        if not left:
            break
        groups = -(-left // group)
        last = groups == 1 or turn == ROUNDS - 1
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("pid", F.lit(turn)), F.lit(groups)))
        done = stored(dealt.groupBy("g").applyInArrow(packer(length, turn, last), "pid long, sequence_id long, offset long, length long"), "packed")
        found.append(done.filter("sequence_id is not null").select("pid", "sequence_id", "offset"))
        rest = done.filter("sequence_id is null").select("pid", "length")
        left = rest.count() if not last else 0
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset of every piece.

    Null text is empty and has its end id only; repeated rows are packed each; an empty table gives no rows.
    """
    pieces = cut_pieces(docs, tokenizer, end_id, length)
    return pieces.join(plan(pieces, length), "pid").drop("pid")


def with_crc(pieces: DataFrame) -> DataFrame:
    """ids_crc32 in place of ids."""
    names = [c for c in pieces.columns if c != "ids"]

    def digest(batches):
        for b in batches:
            crc = pa.array(crc_of(b.column(b.schema.get_field_index("ids"))), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [crc], names=[*names, "ids_crc32"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "ids")
    return pieces.mapInArrow(digest, f"{kinds}, ids_crc32 long")


def op7_pack(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    pieces = cut_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    out = with_crc(pieces).join(plan(pieces), "pid")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
