"""One asset of the rows that several sources have of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.components import connected_components
from marlstone.operators.entities import normal_address
from marlstone.storage import stored


def members(rows: DataFrame, order: list[str]) -> DataFrame:
    """source, id, asset and matched_by of every row of every source: which asset it is of.

    rows: source, id, symbol, contract; a row with several contracts is repeated. order: the sources, best first; others
    come after them. An asset is named after its first row by source and id.

    Rows that share a contract are one asset, also by way of others (connected components of rows and contracts). A row
    without any contract joins the one asset with contracts that has its symbol, case apart; where no asset has, the rows
    of that symbol are one; where several have it, the symbol says nothing and the row is an asset of its own.
    matched_by: contract, symbol, ambiguous, or alone for an asset of one row.

    Null source or id, and a null or empty symbol, match nothing; equal rows count once; a contract of very many rows is
    one node with as many edges, which the components halve in each round.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("source")), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank).cast("int")
    contract = F.when(F.trim("contract") != "", normal_address(F.trim("contract")))
    rows = rows.select("source", F.col("id").cast("string").alias("id"), F.upper(F.trim("symbol")).alias("symbol"), contract.alias("contract")).distinct()
    node = F.concat_ws("|", F.lit("r"), rank.cast("string"), F.coalesce("source", F.lit("")), F.coalesce("id", F.lit("")))
    rows = stored(rows.withColumns({"rank": rank, "node": node}), "unify-rows")
    edges = rows.filter("contract is not null").select(F.col("node").alias("u"), F.concat(F.lit("c|"), "contract").alias("v"))
    found = connected_components(edges)
    with_contract = rows.filter("contract is not null").join(found, "node").select("node", "source", "id", "symbol", "rank", "component").distinct()
    without = rows.join(with_contract.select("node").distinct(), "node", "left_anti").select("node", "source", "id", "symbol", "rank").distinct()
    owners = with_contract.filter("symbol <> ''").groupBy("symbol").agg(F.min("component").alias("one"), F.max("component").alias("other"))
    without = without.join(owners, "symbol", "left").withColumn(
        "component",
        F.when(F.col("one") == F.col("other"), F.col("one")).when(F.col("one").isNotNull() | F.coalesce(F.col("symbol") == "", F.lit(True)), F.col("node")).otherwise(F.concat(F.lit("s|"), "symbol")),
    )
    by = F.when(F.col("one") != F.col("other"), "ambiguous").otherwise("symbol")
    every = with_contract.withColumn("matched_by", F.lit("contract")).unionByName(without.withColumn("matched_by", by).select(*with_contract.columns, "matched_by"))
    every = stored(every, "unify-members")
    names = every.groupBy("component").agg(F.min(F.struct("rank", "source", "id")).alias("first"), F.count_distinct("node").alias("rows"))
    names = names.select("component", F.concat_ws(":", "first.source", "first.id").alias("asset"), "rows")
    out = every.join(names, "component")
    return out.select("source", "id", "asset", F.when((F.col("rows") == 1) & (F.col("matched_by") != "ambiguous"), "alone").otherwise(F.col("matched_by")).alias("matched_by")).distinct()


def golden(rows: DataFrame, found: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """asset, each field and the source it is from: of every field the first value that is not null, by source order, then id.

    rows: source, id and the fields; found: members() of them. Partial minima combine before the shuffle.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("source")), F.lit(0))
    place = F.struct(F.when(rank == 0, len(order) + 1).otherwise(rank), F.col("source"), F.col("id"))
    own = rows.withColumn("id", F.col("id").cast("string")).join(found.select("source", "id", "asset"), ["source", "id"])
    best = lambda f: F.min_by(F.struct(F.col(f).alias("v"), F.col("source").alias("s")), F.when(F.col(f).isNotNull(), F.struct(place, F.col(f)))).alias(f)
    out = own.groupBy("asset").agg(*[best(f) for f in fields])
    return out.select("asset", *[c for f in fields for c in (F.col(f"{f}.v").alias(f), F.when(F.col(f"{f}.v").isNotNull(), F.col(f"{f}.s")).alias(f"{f}_source"))])
