"""Which file to read for which year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Path, name and size of the files of a folder; the contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def discover_sources(
    files: DataFrame, include_any: list[str], include_all: list[str], exclude: list[str], years: tuple[int, int]
) -> DataFrame:
    """One file per year by its name; the first name in order wins."""
    low = F.lower("name")
    wanted = F.lit(False)
    for p in include_any:
        wanted = wanted | low.contains(p)
    for p in include_all:
        wanted = wanted & low.contains(p)
    for p in exclude:
        wanted = wanted & ~low.contains(p)
    dated = files.where(wanted).withColumn("year", F.regexp_extract(low, r"20\d{2}", 0).try_cast("int"))
    first = dated.where(F.col("year").between(*years)).groupBy("year").agg(F.min(F.struct("name", "path")).alias("f"))
    return first.select("year", "f.name", "f.path")


def pick_source(files: DataFrame, word: str = "escola", min_year: int = 2007) -> DataFrame:
    """One file per year: the word in its name, then an extracted file over an archive, then the largest.

    Narrowing the list rule by rule equals the first row in this order.
    """
    low = F.lower("name")
    usable = files.where(low.endswith(".csv") | low.endswith(".zip"))
    ranked = usable.select(
        F.regexp_extract("name", r"20\d{2}|19\d{2}", 0).try_cast("int").alias("year"),
        F.struct(
            F.when(low.contains(word), 0).otherwise(1).alias("other_name"),
            F.when(low.endswith(".csv"), 0).otherwise(1).alias("archive"),
            (-F.col("length")).alias("minus_size"),
            "name",
            "path",
        ).alias("f"),
    )
    best = ranked.where(F.col("year") >= min_year).groupBy("year").agg(F.min("f").alias("f"))
    return best.select("year", "f.name", "f.path", F.when(F.col("f.archive") == 0, "extracted").otherwise("archive").alias("kind"))


def list_folders(files: DataFrame) -> DataFrame:
    """Sources that were written as folders of part files: name of the folder and total size."""
    parts = files.where(~F.col("name").startswith("_") & ~F.col("name").startswith("."))
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    named = parts.select(folder.alias("path"), F.regexp_extract(folder, r"([^/=]+)$", 1).alias("name"), "length")
    return named.groupBy("path", "name").agg(F.sum("length").alias("length"))
