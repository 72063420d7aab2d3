"""Reading, writing and publishing stage tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stage(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_stage(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Full overwrite. With a partition column the rows are rebalanced by it first: each
    partition gets few files, and a large one is still written by many tasks."""
    if partition_by:
        df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


MANIFEST = "MANIFEST.json"


def read_manifest(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Part name -> digest and folder of what is published; empty before the first time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {}
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])


def switch_manifest(spark: SparkSession, path: str, manifest: dict[str, dict[str, str]]) -> None:
    """The new manifest is written beside the old one and takes its place in one rename."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    new, old = hadoop.Path(f"{path}/{uuid.uuid4().hex}.tmp"), hadoop.Path(f"{path}/{MANIFEST}")
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True).encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(old.toUri(), conf).rename(new, old, options)


def part_digests(df: DataFrame, part: str) -> dict[str, str]:
    """Number of rows and an order-free sum of row hashes per value of ``part``: one small row per part."""
    named = F.struct(*[F.col(c) for c in sorted(df.columns)])
    sums = [F.sum(F.xxhash64(F.lit(seed), named).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    rows = df.groupBy(F.col(part).cast("string").alias("part")).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums, F.lit(df.schema.simpleString())).alias("digest"))
    return {str(r["part"]): r["digest"] for r in rows.collect()}


def publish_parts(df: DataFrame, path: str, part: str) -> list[str]:
    """Publish a table by parts (years); returns the parts that were written.

    Parts whose rows are what is already published are not written again, parts that are no
    longer in ``df`` leave. New parts go to a folder of their own, and readers see them only
    when the manifest is switched, so that a write that fails leaves the table as it was.
    Folders that no manifest names any more are left to a clean-up after the last reader.
    """
    spark, old, digests = df.sparkSession, read_manifest(df.sparkSession, path), part_digests(df, part)
    changed = sorted(p for p, d in digests.items() if old.get(p, {}).get("digest") != d)
    if not changed and old.keys() == digests.keys():
        return []
    folder = f"{path}/data-{uuid.uuid4().hex}"
    if changed:
        number = F.array_position(F.array(*[F.lit(p) for p in changed]), F.coalesce(F.col(part).cast("string"), F.lit("None")))
        df.withColumn("_part", number).where(F.col("_part") > 0).hint("rebalance", "_part").write.partitionBy("_part").parquet(folder)
    made = {p: {"digest": digests[p], "folder": f"{folder}/_part={changed.index(p) + 1}" if p in changed else old[p]["folder"]} for p in digests}
    switch_manifest(spark, path, made)
    return changed


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table of the current manifest, in one scan of its folders."""
    manifest = read_manifest(spark, path)
    if not manifest:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(*sorted(m["folder"] for m in manifest.values()))


def publish(spark: SparkSession, stage_path: str, published_path: str, view: str | None = None, part: str | None = None) -> DataFrame:
    """Publish the last stage at its stable place, as a whole or by the values of ``part``."""
    stage = read_stage(spark, stage_path)
    if part:
        publish_parts(stage, published_path, part)
    else:
        publish_parts(stage.withColumn("_all", F.lit("all")), published_path, "_all")
    out = read_published(spark, published_path)
    out = out if part else out.drop("_all")
    if view:
        out.createOrReplaceTempView(view)
    return out


def write_table_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A result table as CSV. ``single_file`` is for tables that are known to have few rows."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True)
