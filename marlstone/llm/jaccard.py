"""Exact Jaccard join of documents by word shingles.

Candidates come from prefixes: of two sets as similar as asked, the first shingles of either, in one order of all
shingles, have one in common. The order is by the number of documents with the shingle, which all documents'
shingles are counted for, so the prefix holds what is rare; a shingle that only one document has joins nothing and
is dropped. A batch of documents sends a shingle once, with its number in the batch, so one that every document has
doesn't fill a range. Documents with a common prefix shingle make a cluster. In a cluster, blocks of documents are joined by
signature trees (nodes with OR-combined token bitmaps and size ranges), which are traversed in pairs; nodes whose
greatest possible overlap can't reach the threshold are dropped, links are verified on the sets. The first round
joins each block with itself and with its cluster's pivot; the second only what the first left in different
components. Only links that join something leave a task, so a group of copies never becomes its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import fresh, row_key
from marlstone.llm.tokens import U64, cuts, mix, pack_sorted, planes, tokens, unpack_sorted, unplanes
from marlstone.operators.components import connected_components
from marlstone.operators.skew import join_spread
from marlstone.storage import scratch, stored

SHINGLE, PERCENT = 3, 90
#: Text of a batch of documents and of a range of shingles; documents and bytes of sets of a block; bytes of one task.
BATCH_BYTES, RANGE_BYTES, BLOCK, BLOCK_BYTES, TASK_BYTES = 8_000_000, 12_000_000, 512, 4_000_000, 8_000_000
#: A posting is the first 48 bits of a shingle's hash and its document's place in the batch. Two shingles with the
#: same 48 bits count as one where candidates are sought, never where links are verified.
PLACE_BITS = 16
FANOUT = 8


def shingle_sets(texts: list[str], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; fewer words are one shingle, none give none."""
    words, bounds = tokens([t.encode() for t in texts])
    out = []
    keys = [U64(0x9E3779B97F4A7C15 + 2 * i) for i in range(n)]
    whole = np.zeros(max(len(words) - n + 1, 0), U64)
    for i, k in enumerate(keys):
        whole += words[i : len(words) - n + 1 + i] * k
    whole = mix(whole)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(whole[lo : hi - n + 1]))
        elif hi > lo:
            short = np.array([hi - lo], U64)
            for i in range(lo, hi):
                short = mix(short * keys[1] + words[i : i + 1])
            out.append(short)
        else:
            out.append(np.empty(0, U64))
    return out


def node_of(s: np.ndarray) -> bytes:
    """Names a set by 120 bits of a cryptographic hash, so equal sets are one node. The last byte is never zero."""
    return hashlib.blake2b(s.tobytes(), digest_size=15).digest() + b"\x01"


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many elements of a set of n can be missing in one that it links with, and one more."""
    return n - -(-n * percent // 100) + 1


def stars(keys: np.ndarray, nodes: np.ndarray):
    """(distinct keys, their least nodes, edges from the least node to the others of its key)."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    run = np.cumsum(first) - 1
    least = nodes[first]
    other = nodes != least[run]
    return keys[first], least, {*zip(least[run][other].tolist(), nodes[other].tolist(), strict=True)}


def as_stars(edges: Iterable[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """The same components with fewer edges and no paths: an edge from each one's least node to its others."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for u, v in edges:
        p, q = find(u), find(v)
        root[max(p, q)] = min(p, q)
    return [(find(x), x) for x in root if find(x) != x]


PACKET = "p int, g long, kind int, a binary, b binary, rows array<struct<k:binary,node:binary,n:int>>"
ROWS_TYPE = pa.list_(pa.struct([("k", pa.binary()), ("node", pa.binary()), ("n", pa.int32())]))
PACKET_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), ROWS_TYPE]
LINK = "u binary, v binary"


def packets(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(PACKET_TYPES)
    names = [x.split()[0] for x in PACKET.split(", ")]
    return pa.table([pa.array(x, t) for x, t in zip(columns, PACKET_TYPES, strict=True)], names=names)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of a text column, and no more rows than places."""
    for batch in batches:
        ends = np.cumsum([len(x.as_py() or "") for x in batch.column(column)])
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, before + most)), at + 1), at + (1 << PLACE_BITS))
            yield batch.slice(at, to - at)
            at = to


def sets_with_owners(texts: list[str], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    sets = shingle_sets(texts, n)
    return sets, np.repeat(np.arange(len(sets), dtype=U64), [len(s) for s in sets])


def _sign(ranges: int, n: int):
    """kind 0: the first posting of each of a batch's shingles in a range, with their numbers; 2: its rows; 3: other postings."""

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for g, part in enumerate(by_bytes(batches, 1, BATCH_BYTES), first):
            sets, owner = sets_with_owners(part.column(1).to_pylist(), n)
            flat = np.concatenate(sets) if len(owner) else np.empty(0, U64)
            postings = np.sort(flat >> U64(PLACE_BITS) << U64(PLACE_BITS) | owner)
            shingle = postings >> U64(PLACE_BITS)
            first = np.concatenate([[True], shingle[1:] != shingle[:-1]]) if len(shingle) else np.empty(0, bool)
            number, rest = np.diff(np.flatnonzero(first), append=len(shingle)).astype(U64), postings[~first]
            postings = postings[first]
            at = cuts(postings, ranges)
            rows = [
                (p, g, 0, pack_sorted(postings[lo:hi]), planes(number[lo:hi]), None)
                for p, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo
            ]
            if len(rest):
                rows.append((g % ranges, g, 3, pack_sorted(rest), None, None))
            own = [{"k": k, "node": node_of(s), "n": len(s)} for k, s in zip(part.column(0).to_pylist(), sets, strict=True)]
            rows.append((g % ranges, g, 2, None, None, own))
            yield from packets(rows).to_batches()

    return run


def _count(key, table):
    """Of each batch's first postings, those whose shingle another posting has, and how many have it; the others pass."""
    kinds = table["kind"].to_numpy()
    mine = np.flatnonzero(kinds == 0).tolist()
    rows = [(0, table["g"][i].as_py(), int(kinds[i]), table["a"][i].as_py(), None, table["rows"][i].as_py()) for i in np.flatnonzero(kinds >= 2).tolist()]
    if mine:
        postings = [unpack_sorted(table["a"][i].as_py()) for i in mine]
        times = np.concatenate([unplanes(table["b"][i].as_py(), U64) for i in mine])
        every = np.concatenate(postings) >> U64(PLACE_BITS)
        shingles = np.sort(every)
        first = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
        number = np.diff(np.concatenate([first, [len(shingles)]])).astype(U64)
        more = times > 1
        np.add.at(number, np.searchsorted(shingles[first], every[more]), times[more] - U64(1))
        shingles, number = shingles[first[number > 1]], number[number > 1]
        for i, own in zip(mine, postings, strict=True):
            wanted = own >> U64(PLACE_BITS)
            at = np.minimum(np.searchsorted(shingles, wanted), max(len(shingles) - 1, 0))
            hit = shingles[at] == wanted if len(shingles) else np.zeros(len(own), bool)
            if hit.any():
                rows.append((0, table["g"][i].as_py(), 0, pack_sorted(own[hit]), planes(number[at[hit]]), None))
    return packets(rows)


def _prefixes(ranges: int, percent: int):
    """kind 0: shingles of the prefixes of a batch in a range, each with its least node; 1: edges among the batch."""

    def run(key, table):
        kinds = table["kind"].to_numpy()
        mine = np.flatnonzero(kinds == 0).tolist()
        if not mine:
            return packets([])
        own = table["rows"][int(np.flatnonzero(kinds == 2)[0])].as_py()
        size = np.array([r["n"] for r in own], np.int64)
        nodes = np.array([r["node"] for r in own], "S16")
        postings = np.concatenate([unpack_sorted(table["a"][i].as_py()) for i in mine])
        number = np.concatenate([unplanes(table["b"][i].as_py(), U64) for i in mine])
        rest = [unpack_sorted(table["a"][i].as_py()) for i in np.flatnonzero(kinds == 3).tolist()]
        if rest:  # their shingles have a first posting here, with an answer, as they come twice
            order = np.argsort(postings)
            at = np.searchsorted(postings[order] >> U64(PLACE_BITS), rest[0] >> U64(PLACE_BITS))
            postings, number = np.concatenate([postings, rest[0]]), np.concatenate([number, number[order][at]])
        place = (postings & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
        common = np.bincount(place, minlength=len(own))
        wanted = prefix_size(size, percent) - (size - common)  # shingles of one document come first, and join nothing
        some = wanted[place] > 0
        place, number, shingle = place[some], number[some], postings[some] >> U64(PLACE_BITS)
        order = np.lexsort((shingle, number, place))
        place, shingle = place[order], shingle[order]
        first = np.searchsorted(place, place)
        keep = np.arange(len(place)) - first < wanted[place]
        shingle, least, edges = stars(shingle[keep], nodes[place[keep]])
        # Edges need no range: they pass in many small groups.
        rows = [(ranges + int.from_bytes(u[:2], "little") % (16 * ranges), 0, 1, u, v, None) for u, v in edges]
        at = cuts(shingle << U64(PLACE_BITS), ranges)
        for p, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if hi > lo:
                rows.append((p, 0, 0, pack_sorted(shingle[lo:hi]), least[lo:hi].tobytes(), None))
        return packets(rows)

    return run


def _meet(key, table):
    """Edges among the nodes of all batches that have a prefix shingle in common; those of batches pass."""
    kinds, a, b = table["kind"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist()
    edges = {(u, v) for kind, u, v in zip(kinds, a, b, strict=True) if kind == 1}
    mine = [i for i, kind in enumerate(kinds) if kind == 0]
    if mine:
        edges |= stars(np.concatenate([unpack_sorted(a[i]) for i in mine]), np.concatenate([np.frombuffer(b[i], "S16") for i in mine]))[2]
    edges = as_stars(edges)
    u, v = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


class Tree:
    """A signature tree: leaves of FANOUT sets in order of size, nodes with OR-combined bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.bits = np.zeros((len(sets), bits // 64), U64)
        for row, i in enumerate(self.order):
            at = (sets[i] & U64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(self.bits[row], at >> 6, U64(1) << (at & 63).astype(U64))
        self.sizes = np.array([len(sets[i]) for i in self.order])
        self.counts = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.root = self._node(0, len(sets))

    def _node(self, lo: int, hi: int) -> dict:
        step = FANOUT
        while step * FANOUT < hi - lo:
            step *= FANOUT
        children = [] if hi - lo <= FANOUT else [self._node(x, min(x + step, hi)) for x in range(lo, hi, step)]
        rows = slice(lo, hi)
        return {
            "lo": lo, "hi": hi, "children": children, "bits": np.bitwise_or.reduce(self.bits[rows], axis=0),
            "least": int(self.sizes[lo]), "most": int(self.sizes[hi - 1]), "count": int(self.counts[rows].min()),
        }


def _possible(p: dict, q: dict, percent: int) -> bool:
    """Whether some set under p can reach the threshold with some set under q.

    A set under p has at least as many bits outside q's bitmap as its fewest bits exceed the common ones; as
    many of its tokens at least are missing under q.
    """
    common = int(np.bitwise_count(p["bits"] & q["bits"]).sum())
    overlap = min(p["most"] - max(0, p["count"] - common), q["most"] - max(0, q["count"] - common))
    return (100 + percent) * overlap >= percent * (p["least"] + q["least"])


def links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT, labels: list | None = None) -> list[tuple[int, int]]:
    """Verified links between left and right (or within left) that join components: a spanning forest of all.

    Indices of right follow those of left. labels: sets with the same label are in one component already.
    """
    sets = left + (right or [])
    first = {x: i for i, x in reversed(list(enumerate(labels)))} if labels else {}
    root = [first[x] for x in labels] if labels else list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    bits = 256
    while bits < 4 * max(map(len, sets)) and bits < 1 << 16:
        bits *= 2
    a = Tree(left, bits)
    b, base = (Tree(right, bits), len(left)) if right is not None else (a, 0)
    out, stack = [], [(a.root, b.root)]
    while stack:
        p, q = stack.pop()
        if right is None and q["hi"] <= p["lo"] or not _possible(p, q, percent):
            continue
        if p["children"] or q["children"]:
            stack += [(x, y) for x in (p["children"] or [p]) for y in (q["children"] or [q])]
            continue
        common = np.bitwise_count(a.bits[p["lo"] : p["hi"], None] & b.bits[None, q["lo"] : q["hi"]]).sum(axis=2).astype(np.int64)
        m, n = a.sizes[p["lo"] : p["hi"], None], b.sizes[None, q["lo"] : q["hi"]]
        most = np.minimum(m - a.counts[p["lo"] : p["hi"], None] + common, n - b.counts[None, q["lo"] : q["hi"]] + common)
        for i, j in np.argwhere((100 + percent) * most >= percent * (m + n)):
            x, y = a.order[p["lo"] + i], b.order[q["lo"] + j] + base
            if x == y or find(x) == find(y):
                continue
            s, t = sets[x], sets[y]
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            same = int((t[at] == s).sum())
            if (100 + percent) * same >= percent * (len(s) + len(t)):
                root[find(x)] = find(y)
                out.append((x, y))
    return out


def _join_blocks(percent: int):
    """Links of each pair of blocks (lo, hi) of each cluster in the task, as stars."""

    def run(key, table):
        rows = sorted(
            zip(*[table[c].to_pylist() for c in ("cluster", "lo", "hi", "second", "node", "label", "s")], strict=True), key=lambda r: r[:5]
        )
        edges, at = [], 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][:3] == rows[at][:3]:
                to += 1
            own = [r for i, r in enumerate(rows[at:to]) if not i or r[3:5] != rows[at + i - 1][3:5]]  # a set that came twice
            sets, labels, nodes = [np.frombuffer(r[6], U64) for r in own], [r[5] for r in own], [r[4] for r in own]
            split = sum(not r[3] for r in own)
            if own[0][1] == own[0][2]:
                found = links(sets, None, percent, labels) if len(own) > 1 else []
            else:
                found = links(sets[:split], sets[split:], percent, labels) if 0 < split < len(own) else []
            edges += [(nodes[i], nodes[j]) for i, j in found]
            at = to
        u, v = zip(*stars, strict=True) if (stars := as_stars(edges)) else ((), ())
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    return run


def _joined(rows: DataFrame, percent: int, label: str) -> DataFrame:
    """Links of rows dealt by cluster, lo and hi, in tasks of TASK_BYTES."""
    with scratch() as leave:
        rows = stored(rows, f"{label}-dealt")
        moved = rows.agg(F.sum(F.col("n") * 8)).first()[0] or 0
        tasks = max(1, -(-int(moved) // TASK_BYTES))
        dealt = rows.withColumn("g", F.pmod(F.xxhash64("cluster", "lo", "hi"), F.lit(tasks)))
        return leave(dealt.repartition(tasks, "g").groupBy("g").applyInArrow(_join_blocks(percent), LINK), label)


def candidate_clusters(docs: DataFrame, percent: int, range_bytes: int, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: k, text; members: k, node, n of every row; inside: node, cluster of those that may link)."""
    rows = docs.select(row_key().alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // range_bytes))
    signed = rows.mapInArrow(_sign(ranges, n), PACKET)
    counted = stored(signed.repartition(ranges, "p").groupBy("p").applyInArrow(_count, PACKET), "jaccard-counted")
    members = counted.filter("kind = 2").select(F.inline("rows"))
    prefixes = counted.groupBy("g").applyInArrow(_prefixes(ranges, percent), PACKET)
    edges = prefixes.groupBy("p").applyInArrow(_meet, LINK)
    clusters = connected_components(edges).select("node", F.col("component").alias("cluster"))
    return rows, members, clusters


def similar_links(docs: DataFrame, percent: int = PERCENT, range_bytes: int = RANGE_BYTES, n: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows: k, node, n; links: u, v between nodes). k is the row's key, a node a distinct shingle set."""
    rows, members, clusters = candidate_clusters(docs, percent, range_bytes, n)
    one = members.groupBy("node").agg(F.min("k").alias("k"), F.first("n").alias("n"))
    inside = stored(one.join(clusters, "node"), "jaccard-clusters")

    def sets(batches):
        for batch in batches:
            for part in by_bytes(iter([batch]), 0, BATCH_BYTES):
                s = pa.array([x.tobytes() for x in shingle_sets(part.column(0).to_pylist(), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], s], names=["node", "n", "cluster", "s"])

    # Always the same join, whatever the size of the side: AQE can split it, and the cost follows the input.
    texts = rows.join(inside.hint("merge"), "k").dropDuplicates(["node"]).select("text", "node", "n", "cluster")
    whole = stored(texts.mapInArrow(sets, "node binary, n int, cluster binary, s binary"), "jaccard-sets")

    def number(count, total):
        return F.greatest(F.ceil(F.col(count) / block), F.ceil(F.col(total) * 8 / BLOCK_BYTES), F.lit(1)).cast("int")

    sizes = whole.groupBy("cluster").agg(F.count("*").alias("count"), F.sum("n").alias("total"), F.min("node").alias("pivot"))
    sizes = stored(sizes.select("cluster", "pivot", number("count", "total").alias("blocks")), "jaccard-sizes")
    own = join_spread(whole, sizes.select("cluster", "blocks"), "cluster", F.col("node"))
    own = own.withColumn("lo", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    pivots = sizes.filter("blocks > 1").select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("lo"))
    pivots = whole.join(pivots, F.col("node") == F.col("pivot")).select(own.columns)
    first = own.unionByName(pivots).withColumns({"hi": F.col("lo"), "second": F.lit(False), "label": F.col("node")})
    found = _joined(first, percent, "jaccard-first")

    # What the first round left apart in clusters of several blocks: all but the largest component, with everything.
    large = sizes.filter("blocks > 1").select("cluster")
    left = join_spread(whole, large, "cluster", F.col("node")).join(connected_components(found), "node", "left")
    left = stored(left.select("cluster", "node", "n", "s", F.coalesce("component", "node").alias("label")), "jaccard-left")
    parts = left.groupBy("cluster", "label").agg(F.count("*").alias("count"), F.sum("n").alias("total"))
    per = parts.groupBy("cluster").agg(
        F.max(F.struct("count", "label", "total")).alias("most"), F.sum("count").alias("count"), F.sum("total").alias("total")
    ).filter(F.col("count") > F.col("most.count"))
    per = per.select("cluster", F.col("most.label").alias("most"), F.col("most.count").alias("c"), F.col("most.total").alias("t"), (F.col("count") - F.col("most.count")).alias("count"), (F.col("total") - F.col("most.total")).alias("total"))
    per = stored(per.select("cluster", "most", number("count", "total").alias("few"), number("c", "t").alias("many")), "jaccard-apart")
    apart = join_spread(left, per, "cluster", F.col("node"))
    is_few = F.col("label") != F.col("most")
    apart = apart.withColumn("block", F.pmod(F.xxhash64("node"), F.when(is_few, F.col("few")).otherwise(F.col("many"))).cast("int"))
    apart = apart.withColumn("block", F.when(is_few, F.col("block")).otherwise(F.col("block") + F.col("few")))
    apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") + F.when(is_few, F.col("many")).otherwise(0) - 1)))
    second = apart.select(
        "cluster", "node", "n", "s", "label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        (F.col("block") > F.col("other")).alias("second"),
    )
    return members, found.unionByName(_joined(second, percent, "jaccard-second"))


def rooted_rows(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """k, n and root of every row: its component's least node; rows without words are their own.

    Of all that is stored on the way only these rows stay.
    """
    with scratch() as leave:
        members, found = similar_links(docs, percent, n=n)
        labels = connected_components(found)
        rows = join_spread(members, labels, "node", F.col("k"), "left")
        return leave(rows.select("k", "n", F.coalesce("component", "node").alias("root")), "jaccard-rows")


def similar_components(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Rows link when percent of the union of their sets of n-word shingles is common to both; component_id is the least
    doc_id reachable. Rows without words link with nothing; equal rows are one node. A null id never names a
    component unless all its members' are null. Other columns of docs, whatever their names, play no part; very long
    texts are whole sets; an empty table gives no rows.
    """
    rooted = rooted_rows(docs, percent, n).dropDuplicates(["k"])
    ids = docs.select("doc_id", row_key().alias("k"))
    rows = stored(ids.join(rooted, "k"), "jaccard-ids")
    least = stored(rows.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "jaccard-least")
    named = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return join_spread(rows, least, "root", F.col("k"), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), named.alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """One row of each component with all columns: the one with the least doc_id (nulls last), then the least key.

    Rows without words stay, but for repeats of a row. Of rows with the same id and text any one stays. Columns of
    docs keep their values whatever their names.
    """
    key, = fresh(docs, "k")
    rooted = rooted_rows(docs, percent, n).dropDuplicates(["k"])
    rows = docs.select("doc_id", row_key().alias("k")).distinct().join(rooted, "k")
    own = F.when(F.col("n") == 0, F.col("k"))
    kept = rows.groupBy("root", own.alias("own")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("first"))
    kept = stored(kept.select(F.col("first.k").alias(key)), "jaccard-kept")
    out = docs.withColumn(key, row_key()).join(kept, key, "left_semi")
    return out.dropDuplicates([key]).select(docs.columns)


def op9_similar_components(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    return similar_components(table(spark, sf_dir, "documents"))
