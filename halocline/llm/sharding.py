"""Sharding by extendible hashing.

A directory maps the leading bits of a hash of the id to shards. Only a bucket that holds more than
``max_bytes`` is split, on one more bit, until each shard fits. One aggregate gives the sizes of all
buckets of the next ``STEP`` levels, so a pass over the rows (id, size, hash; never texts) settles ``STEP``
bits, and later passes read only rows of buckets that are still too large.

The hash has 60 bits of the id's MD5, then 60 bits of the row number's, so that even rows of one single
id can be told apart. A row that is larger than the limit by itself makes a shard alone, with
``fits`` false. Null ids hash as the text ``null``; null texts have no bytes. Repeated rows stay
repeated. An empty table gives no shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm.common import written

BITS, STEP = 60, 12


def hash_bits(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("null")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def settle(rows: DataFrame, base: int, max_bytes: int) -> DataFrame:
    """Leaf of each bucket (``head``, ``p`` of ``base + STEP`` bits); a null depth if it has to be split further."""
    deepest = base + STEP
    at = F.explode(F.sequence(F.lit(base), F.lit(deepest)))
    fine = rows.groupBy("head", "p").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    paths = fine.select("head", "p", "size", "n", at.alias("depth")).withColumn("up", F.expr(f"shiftright(p, {deepest} - depth)"))
    sums = paths.groupBy("head", "depth", "up").agg(F.sum("size").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    leaf = (F.col("shard_bytes") <= max_bytes) | (F.col("shard_rows") == 1)
    chosen = paths.select("head", "p", "depth", "up").join(sums.filter(leaf), ["head", "depth", "up"])
    first = chosen.groupBy("head", "p").agg(F.min(F.struct("depth", "up", "shard_bytes", "shard_rows")).alias("leaf"))
    return fine.select("head", "p").join(first, ["head", "p"], "left").select("head", "p", "leaf.*")


def assign_shards(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, shard (``depth-prefix``), depth, shard_bytes, shard_rows, fits."""
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    numbered = docs.select(F.col(f"`{id_col}`").alias("k"), size.alias("size"), F.monotonically_increasing_id().cast("string").alias("rid"))
    hashed = numbered.select("k", "size", hash_bits(F.col("k").cast("string")).alias("h"), hash_bits(F.col("rid")).alias("h2"))
    left, _ = written(hashed, "shard-rows")
    done: list[DataFrame] = []
    for base in range(0, 2 * BITS, STEP):
        by_id = base < BITS
        bits = F.shiftright("h" if by_id else "h2", BITS - base % BITS - STEP)
        # rows that share all bits of their ids are one bucket, which the row numbers' bits go on to split
        rows = left.withColumn("p", bits).withColumn("head", F.lit(0).cast("long") if by_id else F.col("h"))
        leaves, _ = written(settle(rows, base % BITS, max_bytes), "shard-leaves")
        joined = rows.join(leaves, ["head", "p"])
        names = ["depth", "up"] if by_id else [F.lit(BITS), "head", "depth", "up"]
        done.append(
            joined.filter("depth is not null").select(
                F.col("k").alias(id_col), F.col("size").alias("n_bytes"), F.concat_ws("-", *names).alias("shard"),
                (F.col("depth") + (0 if by_id else BITS)).alias("depth"), "shard_bytes", "shard_rows",
                (F.col("shard_bytes") <= max_bytes).alias("fits"),
            )
        )
        if not leaves.filter("depth is null").head(1):
            break
        left, _ = written(joined.filter("depth is null").select("k", "size", "h", "h2"), "shard-rows")
    return reduce(DataFrame.unionByName, done)


def write_shards(docs: DataFrame, path: str, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each shard's documents to ``path/shard=...`` and return the directory, one row per shard.

    Rows are matched to their shard by id. Rows that repeat an id lie together, in the first shard that one of them was assigned to. Where the
    documents have a column ``shard``, the folders are named by ``shard_``, with as many underscores as it takes.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # columns of any name go through under plain ones
    folder = "shard"
    while folder.lower() in {n.lower() for n in names}:
        folder += "_"
    shards, _ = written(assign_shards(docs, max_bytes, id_col, text_col), "shard-of")
    of = shards.groupBy(F.col(id_col).alias("k")).agg(F.min("shard").alias("of"))
    placed = docs.toDF(*inner).join(of, F.col(inner[names.index(id_col)]).eqNullSafe(F.col("k")))
    placed = placed.select(*[F.col(i).alias(n) for i, n in zip(inner, names)], F.col("of").alias(folder))
    placed.repartition(folder).write.partitionBy(folder).parquet(path)
    return shards.select("shard", "depth", "shard_bytes", "shard_rows", "fits").distinct()
