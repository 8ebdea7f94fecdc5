"""Connected components of links between integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwave.session import scratch_path


def stored(df: DataFrame, name: str, codec: str = "snappy", made: list[DataFrame] | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: short lineage that survives lost executors.

    The table is also added to ``made``, for a caller that removes what it no longer needs (:func:`dropped`).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.parquet(path)
    if made is not None:
        made.append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of the links (a, b) that is not its component's smallest id; root is that id.

    Alternating rounds: every id links its larger neighbours to its smallest one, then its smaller neighbours.
    A hub with very many links is only aggregated (minimum) and joined, never gathered. No links give no rows.
    """
    low, high = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    e = stored(edges.where(F.col("a") != F.col("b")).select(high, low).distinct(), "links")
    seen = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        before, e = e, stored(small.unionByName(near.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links")
        dropped(before)
