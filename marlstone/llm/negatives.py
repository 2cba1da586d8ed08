"""Hard negatives of an embedding table by exact integer scores from packed products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.storage import stored

#: Components of a block: anchors and candidates meet in cells of one block each, so a task's memory is bounded.
BLOCK_VALUES = 1 << 22
#: Candidates in one wide integer: those of all components stay in a core's cache.
FIELDS = 8192
LONG = np.iinfo(np.int64)


def quantised(vectors: pa.Array) -> np.ndarray:
    """A row of floor(256 * x) for each vector, exact in doubles; shorter vectors end in zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    values = np.floor(256.0 * np.asarray(vectors.flatten(), dtype=np.float64))
    d = int(sizes.max(initial=0))
    if (sizes == d).all():
        return values.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d))
    out[np.arange(d) < sizes[:, None]] = values
    return out


def field_bytes(d: int, a: int, b: int) -> int:
    """Bytes of a field that holds any sum of d products of components biased by their bounds a and b."""
    bits = (d * 2 * a * 2 * b).bit_length()
    return 4 if bits <= 32 else 8 if bits <= 64 else -(-bits // 64) * 8


def packed(columns: np.ndarray, bound: int, width: int) -> list[int]:
    """For each component one wide integer: that component of every candidate, biased to be no less than 0, in fields of width bytes."""
    if width <= 8:
        return [int.from_bytes((c.astype(np.int64) + bound).astype(f"<u{width}").tobytes(), "little") for c in columns.T]
    return [int.from_bytes(b"".join((int(x) + bound).to_bytes(width, "little") for x in c), "little") for c in columns.T]


def scores(anchors: np.ndarray, candidates: np.ndarray):
    """For each anchor the integer inner products with all candidates, exact, nearest long beyond 64 bits.

    Both sides are biased to be non-negative, so no field borrows from the next; one multiplication of a wide integer
    with an anchor's component multiplies that component of FIELDS candidates. The biases' share is taken off after.
    """
    n, d = candidates.shape[0], max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (anchors, candidates))
    a, b = (int(np.abs(x).max(initial=0)) for x in (anchors, candidates))
    width = field_bytes(d, a, b)
    blocks = [(i, packed(candidates[i : i + FIELDS], b, width)) for i in range(0, n, FIELDS)]
    if width <= 8:
        exact = candidates.astype(np.int64)
        shares = a * exact.sum(axis=1) + d * a * b
    else:
        shares = [a * sum(map(int, row)) + d * a * b for row in candidates]
    for row in anchors:
        own = [int(x) for x in row]
        parts = []
        for i, wide in blocks:
            total = 0
            for x, w in zip(own, wide, strict=True):
                if x + a:
                    total += (x + a) * w
            raw = total.to_bytes(width * min(FIELDS, n - i), "little")
            if width <= 8:
                parts.append(np.frombuffer(raw, f"<u{width}").astype(np.int64))
            else:
                parts.extend(int.from_bytes(raw[k : k + width], "little") for k in range(0, len(raw), width))
        if width <= 8:  # modulo 2**64 in between; the scores themselves fit
            yield (np.concatenate(parts) if parts else np.empty(0, np.int64)) - shares - b * sum(own)
        else:
            yield np.array([min(max(s - t - b * sum(own), LONG.min), LONG.max) for s, t in zip(parts, shares, strict=True)], dtype=np.int64)


def first(score: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The k places of among with the highest scores, highest first, ties by place."""
    own = score[among]
    if len(among) > k:
        far = own >= np.partition(own, len(own) - k)[len(own) - k]
        among, own = among[far], own[far]
    return among[np.argsort(~own, kind="stable")][:k]  # ~x is -x - 1, of every long


def _sorted(cell: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The cell's rows by id, null last, and their labels."""
    cell = cell.sort_by([("vec_id", "ascending")])
    return cell, cell["label"].to_numpy()


def _matrix(cell: pa.Table) -> np.ndarray:
    return quantised(cell["embedding"].combine_chunks() if cell.num_rows else pa.array([], cell.schema.field("embedding").type))


def _table(schema: pa.Schema, ids: pa.ChunkedArray, columns: list[list], places: list[np.ndarray]) -> pa.Table:
    at = np.concatenate(places) if places else np.empty(0, np.int64)
    return pa.table([*[pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(columns, schema, strict=False)], ids.take(pa.array(at, pa.int64())).combine_chunks()], schema)


def _positives(k: int):
    schema = pa.schema([("row", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def of(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        candidates, labels = _sorted(candidates)
        ids, rows, found, at = candidates["vec_id"].fill_null(LONG.min).to_numpy(), [], [], []
        their, ours = _matrix(candidates), _matrix(anchors)
        anchor_labels, anchor_ids, anchor_rows = (anchors[c].to_numpy() for c in ("label", "vec_id", "row"))
        for label in np.unique(anchor_labels):
            same, own = np.flatnonzero(labels == label), np.flatnonzero(anchor_labels == label)
            for i, score in zip(own, scores(ours[own], their[same]), strict=True):
                best = first(score, np.flatnonzero(ids[same] != anchor_ids[i]), k)
                rows.append(np.full(len(best), anchor_rows[i]))
                found.append(score[best])
                at.append(same[best])
        return _table(schema, candidates["vec_id"], [rows, found], at)

    return of, "row long, score long, id long"


def _negatives(k: int, low: int, high: int):
    schema = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])

    def of(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        candidates, labels = _sorted(candidates)
        rows, places, found, at = [], [], [], []
        anchor_labels, anchor_rows, positives = anchors["label"].to_numpy(), anchors["row"].to_numpy(), anchors["positives"].to_pylist()
        for i, score in enumerate(scores(_matrix(anchors), _matrix(candidates))):
            others = labels != anchor_labels[i]
            for place, p in enumerate(positives[i]):
                least, most = -(-low * p // 100), high * p // 100  # 100 * score is compared, in whole numbers
                if not LONG.min <= least <= most <= LONG.max:
                    continue
                best = first(score, np.flatnonzero(others & (score >= least) & (score <= most)), k)
                rows.append(np.full(len(best), anchor_rows[i]))
                places.append(np.full(len(best), place))
                found.append(score[best])
                at.append(best)
        return _table(schema, candidates["vec_id"], [rows, places, found], at)

    return of, "row long, place int, score long, id long"


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors: vec_id, label, embedding; anchor says which rows are anchors. A component x becomes floor(256 * x); scores
    are integer inner products, higher first, ties by smaller vec_id (null last). Positives are the anchor's best rows
    of its label, the anchor's own vec_id excepted; negatives of a positive the best rows of other labels with
    low * positive <= 100 * score <= high * positive. Fewer are returned where there are fewer.

    Rows with a null label, a null vector or a component that is null or not finite take no part. Shorter vectors end
    in zeros; scores beyond 64 bits count as the nearest long; repeated rows count each, so a repeated anchor repeats
    its result; other columns play no part; an empty table gives no rows.

    Every anchor meets every candidate, in cells of a block of each; a cell returns its best few for each anchor, and
    the cells' are ranked again. Blocks are dealt by row numbers that were written, so no label or copy is hot.
    """
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * 256) < float("inf")))
    rows = vectors.filter(F.col("label").isNotNull() & x.isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    n, m, d = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("embedding"))).first()
    size = max(1, BLOCK_VALUES // max(1, d or 0))
    spread = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 1024))
    across, down = max(1, spread, -(-n // size)), max(1, -(-m // size))
    block = lambda k: F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    candidates = rows.select(every(down).alias("a"), block(across).alias("c"), "vec_id", "label", "embedding").groupBy("a", "c")
    anchors = rows.filter("anchor").select(*[F.col(c).alias(c) for c in ("row", "vec_id", "label", "embedding")])  # columns apart from the candidates'

    def met(some: DataFrame, of, schema: str) -> DataFrame:
        cells = some.withColumn("a", block(down)).withColumn("c", every(across)).groupBy("a", "c")
        return cells.cogroup(candidates).applyInArrow(of, schema)

    best = lambda keys, k, df: df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id")))).filter(F.col("n") <= k)
    held = stored(best(["row"], positives, met(anchors, *_positives(positives))), "negatives-positives")
    theirs = held.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "score"))), lambda p: p["score"]).alias("positives"))
    out = best(["row", "place"], negatives, met(anchors.join(theirs, "row"), *_negatives(negatives, low, high)))
    named = held.select("row", (F.col("n") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = out.join(named, ["row", "place"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("n").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label = r.label as same, r.vec_id as id, list_dot_product(a.v, r.v)::bigint as score from r a join r on a.vec_id % 100 = 0 and r.vec_id <> a.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, id))::int as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 100 * score between 80 * positive_score and 100 * positive_score qualify rank <= 5"""
