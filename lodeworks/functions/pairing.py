"""Pairs of rows that share an entity, also where one entity has very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.storage import bounded, stored

#: Rows of an entity that one task pairs with as many others, at most.
TILE = 5000
#: Pairs that one task of paired() makes, about.
BLOCK_PAIRS = 2_000_000
#: Tasks of paired() at most; beyond, each makes more pairs.
MOST_BLOCKS = 20_000


def sharing(rows: DataFrame, entity: str, key: str, left: list[Column], right: list[Column]) -> DataFrame:
    """entity and the columns of left and right (made from rows) of all pairs of rows of one entity. rows: read three times, so stored or cheap.

    The rows of an entity of more than TILE rows are cut into tiles by the hash of their key; each pair of tiles is a join
    key of its own, so the pairs are spread over tasks. Pairs are the same; null entities have none."""
    sizes = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col(entity).isNotNull() & (F.col("_n") > TILE))
    hot = stored(sizes.select(entity, F.ceil(F.col("_n") / TILE).cast("int").alias("_tiles")), "hot")
    if hot.isEmpty():
        return rows.select(entity, *left).join(rows.select(entity, *right), entity)
    wide = rows.join(bounded(hot), entity, "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    own, others = F.pmod(F.xxhash64(key), F.col("_tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    one = wide.select(entity, *left, own.alias("_i"), others.alias("_j"))
    two = wide.select(entity, *right, own.alias("_j"), others.alias("_i"))
    return one.join(two, [entity, "_i", "_j"]).drop("_i", "_j")


def _blocks(rows: DataFrame, blocks: int) -> tuple[DataFrame, int]:
    """rows with _block: ranges of _k (parts of its hash, if it is no number) of about equal rows, and the number of blocks."""
    fine = 16 * blocks
    bucket = F.pmod(F.xxhash64("_k"), F.lit(fine)).cast("int")
    if dict(rows.dtypes)["_k"] in ("tinyint", "smallint", "int", "bigint"):
        low, high = rows.agg(F.min(F.col("_k").cast("double")), F.max(F.col("_k").cast("double"))).first()
        if low is not None and low < high:
            place = F.floor((F.col("_k").cast("double") - F.lit(low)) / F.lit(high - low) * fine)
            bucket = F.least(place, F.lit(fine - 1)).cast("int")
    counts = sorted(rows.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect())
    share = sum(n for _, n in counts) / blocks
    placed, at, held = [], 0, 0.0
    for b, n in counts:
        parts = round(n / share)
        if held and held + n > share:
            at, held = at + 1, 0.0
        placed.append((b, at, max(1, parts)))
        at, held = (at + parts, 0.0) if parts > 1 else (at, held + n)
    spread = rows.sparkSession.createDataFrame(placed, "_b int, _first int, _parts int")
    inside = F.pmod(F.xxhash64(F.lit(1), F.col("_k")), F.col("_parts")).cast("int")
    return rows.withColumn("_b", bucket).join(F.broadcast(spread), "_b").withColumn("_block", F.col("_first") + inside).drop("_b", "_first", "_parts"), at + 1


def paired(rows: DataFrame, entity: str, key: str, values: list[str], *aggregates: Column) -> DataFrame:
    """a < b and the aggregates over all entities that both have, of all pairs that share one. An aggregate reads the values of
    the two sides as fields of the structs x and y. rows: one a key and entity; read several times, so stored or cheap.

    No pair is shuffled: the keys are cut into blocks, an entity's rows travel as one list to each block that it has keys in
    (without smaller keys than those), and a block's pairs are made and added up where its lists meet. An entity of more than
    TILE rows is several lists, each of which meets all. Null keys and entities have no pairs."""
    rows = rows.where(F.col(entity).isNotNull() & F.col(key).isNotNull()).select(F.col(entity).alias("_e"), F.col(key).alias("_k"), *values)
    sizes = rows.groupBy("_e").agg(F.count(F.lit(1)).alias("_n"))
    met = sizes.agg(F.sum(F.col("_n").cast("double") * (F.col("_n") - 1)) / 2).first()[0] or 0
    hot = stored(sizes.where(F.col("_n") > TILE).select("_e", F.ceil(F.col("_n") / TILE).cast("int").alias("_tiles")), "hot")
    rows, blocks = _blocks(rows, min(MOST_BLOCKS, max(rows.sparkSession.sparkContext.defaultParallelism, int(met / BLOCK_PAIRS) + 1)))
    each = F.sort_array(F.collect_list(F.struct("_k", "_block", *values))).alias("left")
    # Lists are stored, so that the files of their shuffle are gone when the blocks are dealt out.
    if hot.isEmpty():
        lists = stored(rows.groupBy("_e").agg(each).select("left"), "lists").select("left", F.col("left").alias("right"))
    else:
        tiled = rows.join(bounded(hot), "_e", "left").withColumn("_tile", F.pmod(F.xxhash64("_k"), F.coalesce("_tiles", F.lit(1))))
        tiles = stored(tiled.groupBy("_e", "_tile").agg(each), "tiles")
        lists = tiles.select("_e", "left").join(tiles.select("_e", F.col("left").alias("right")), "_e").select("left", "right")
    apart = lists.select("left", "right", F.explode(F.array_distinct(F.col("left._block"))).alias("_block"))
    own = apart.select("_block", F.filter("left", lambda x: x["_block"] == F.col("_block")).alias("left"), "right")
    above = F.filter("right", lambda y: y["_k"] > F.col("left")[0]["_k"])
    sent = own.select("_block", "left", above.alias("right"))
    # Arrays of plain values: structs would be twice as large.
    sent = sent.select("_block", *(F.col(f"{side}.{c}").alias(side + c) for side in ("left", "right") for c in ("_k", *values)))

    def zipped(side: str) -> Column:
        return F.explode(F.arrays_zip(*(side + c for c in ("_k", *values)))).alias(side)

    def read(side: str) -> list[Column]:
        return [F.struct(*(F.col(f"{side}.{side}{v}").alias(v) for v in values)).alias("x" if side == "left" else "y")] if values else []

    one = sent.repartitionById(blocks, "_block").select("_block", zipped("left"), *("right" + c for c in ("_k", *values)))
    both = one.select("_block", "left", zipped("right")).where("left.left_k < right.right_k")
    both = both.select("_block", F.col("left.left_k").alias("a"), F.col("right.right_k").alias("b"), *read("left"), *read("right"))
    return both.groupBy("_block", "a", "b").agg(*aggregates).drop("_block")
