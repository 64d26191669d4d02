"""Which urls were fetched, are being fetched, or are dead: state that outlives a run.

A run appends one table of url states, in parts by hash of the url, and beside it a Bloom
filter of each part as bitmaps. A later run asks the filters first and then reads only those
parts of those runs that may hold one of its urls.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import is_blank
from gleaner.session import cut_lineage

FETCHING, FETCHED, DEAD, FAILED = "fetching", "fetched", "dead", "failed"
PARTS = 64
#: Bits of a filter per url, and bits that a url sets: about one false hit in a thousand.
BITS, HASHES = 16, 6
_BLOCK = 32_768
_URLS = "url string, status string, tries int, at timestamp, run long, part int"
_FILTERS = "block long, blocks long, bits binary, run long, part int"


def _part(url: str) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(PARTS)).cast("int")


def _places(blocks: Column) -> Column:
    """The bits that a url sets, counted over all blocks of a filter."""
    size = blocks * _BLOCK
    return F.array(*[F.pmod(F.xxhash64(F.lit(k + 1), F.col("url")), size) for k in range(HASHES)])


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def record(states: DataFrame, path: str, run: int) -> None:
    """Add the states (url, status, tries, at) that a run leaves; each url once.

    A run that is repeated replaces its own table only. The filters are written first: a table
    without them would not be seen.
    """
    rows = cut_lineage(states.select("url", "status", F.col("tries").cast("int").alias("tries"), "at", _part("url").alias("part")), "url-states")
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") * BITS / _BLOCK).alias("blocks"))
    bit = rows.join(sizes, "part").select("part", "blocks", F.explode(_places(F.col("blocks"))).alias("bit"))
    filters = bit.groupBy("part", "blocks", F.expr(f"bit div {_BLOCK}").alias("block")).agg(
        F.bitmap_construct_agg(F.expr(f"bit % {_BLOCK}")).alias("bits")
    )
    filters.write.mode("overwrite").partitionBy("part").parquet(f"{path}/filters/run={run}")
    rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/urls/run={run}")


def _may_hold(urls: DataFrame, path: str) -> DataFrame:
    """``url, run, part``: the parts of runs whose filter has all bits of a url."""
    filters = _read(urls.sparkSession, f"{path}/filters", _FILTERS)
    sizes = filters.select("run", "part", "blocks").distinct()
    asked = urls.select("url", _part("url").alias("part")).join(sizes, "part")
    bits = asked.select("url", "run", "part", F.explode(_places(F.col("blocks"))).alias("bit"))
    bits = bits.select("url", "run", "part", F.expr(f"bit div {_BLOCK}").alias("block"), F.expr(f"cast(bit % {_BLOCK} as int)").alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", F.expr("bit div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte, F.expr("cast(bit % 8 as int)")) == 1
    hit = bits.join(filters.select("run", "part", "block", "bits"), ["run", "part", "block"]).filter(is_set)
    return hit.groupBy("url", "run", "part").agg(F.count("*").alias("n")).filter(F.col("n") == HASHES).drop("n")


def known_states(urls: DataFrame, path: str) -> DataFrame:
    """The last state (url, status, tries, at) of those urls that any run has left one for."""
    candidates = cut_lineage(_may_hold(urls.select("url").distinct(), path), "candidates")
    stored = _read(urls.sparkSession, f"{path}/urls", _URLS)
    # the partition columns of the candidates prune the files of the other parts and runs
    places = F.broadcast(candidates.select("run", "part").distinct())  # at most PARTS rows for each run
    rows = stored.join(places, ["run", "part"], "left_semi").join(candidates, ["run", "part", "url"], "left_semi")
    last = rows.groupBy("url").agg(F.max(F.struct("run", "at", "status", "tries")).alias("s"))
    return last.select("url", "s.status", "s.tries", "s.at")


def claim(
    tasks: DataFrame, path: str, at: Column, stale: str = "1 hour", max_tries: int = 3, key: str = "url"
) -> DataFrame:
    """Tasks that may be fetched now, each url once, with the ``tries`` it will then have had.

    Skipped are fetched and dead urls, those that another run has been fetching for less than
    ``stale``, and those that have failed ``max_tries`` times. Blank urls are no tasks.
    """
    filled = tasks.filter(~is_blank(F.col(key)))
    first = Window.partitionBy(key).orderBy(*[F.col(f"`{c}`") for c in tasks.columns])
    once = filled.withColumn("#n", F.row_number().over(first)).filter("`#n` = 1").drop("#n")
    known = known_states(filled.select(F.col(key).alias("url")), path).withColumnRenamed("url", key)
    busy = (F.col("status") == FETCHING) & (F.col("at") + F.expr(f"interval {stale}") > at)
    closed = F.col("status").isin(FETCHED, DEAD) | busy | (F.col("tries") >= max_tries)
    open_ = once.join(known.select(key, "status", F.col("tries").alias("tries"), "at"), key, "left").filter(~F.coalesce(closed, F.lit(False)))
    return open_.withColumn("tries", F.coalesce("tries", F.lit(0)) + 1).drop("status", "at")


def compact(spark: SparkSession, path: str, target: str, run: int) -> None:
    """All runs as one, in a new folder: the last state of each url."""
    rows = _read(spark, f"{path}/urls", _URLS)
    last = rows.groupBy("url").agg(F.max(F.struct("run", "at", "status", "tries")).alias("s"))
    record(last.select("url", "s.status", "s.tries", "s.at"), target, run)
