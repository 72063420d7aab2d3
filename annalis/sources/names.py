"""Names and kinds of the columns of files, as a table.

Tasks read the first line of delimited files and the footer of parquet files, never the
rows, so that thousands of yearly files with drifting layouts are compared as data and no
name passes through the driver.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES_SCHEMA = "file string, ordinal int, column string, kind string, rows long"
NUMBER, TEXT, FLAG, TIME, OTHER = "number", "text", "flag", "time", "other"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Local paths may hold characters that a URI may not, so they are not parsed as one."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def kind_of(t: pa.DataType) -> str:
    is_ = pa.types
    if is_.is_dictionary(t):
        return kind_of(t.value_type)
    if is_.is_integer(t) or is_.is_floating(t) or is_.is_decimal(t):
        return NUMBER
    if is_.is_string(t) or is_.is_large_string(t):
        return TEXT
    return FLAG if is_.is_boolean(t) else TIME if is_.is_temporal(t) else OTHER


def header_names(stream: io.BufferedIOBase, encoding: str, seps: tuple[str, ...], min_cols: int) -> list[str]:
    """Names in the first record, which may hold quoted separators and line breaks.

    The separator is the first that gives ``min_cols`` names, else the last of ``seps``. An empty
    stream has no names.
    """
    record = b""
    while line := stream.readline():
        record += line
        if record.count(b'"') % 2 == 0:
            break
    text = record.decode(encoding).removeprefix("\ufeff").rstrip("\r\n")
    names: list[str] = []
    for sep in seps if text else ():
        names = next(csv.reader(io.StringIO(text, newline=""), delimiter=sep))
        if len(names) >= min_cols:
            break
    return names


def _batches(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch["file"].to_pylist():
            names, kinds, rows = read(*_open(file))
            n = len(names)
            columns = [pa.array([file] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array([rows] * n, pa.int64())]
            yield pa.record_batch(columns, ["file", "ordinal", "column", "kind", "rows"])


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Paths only: no column of the content is asked for, so it is not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return found.select(F.col("_metadata.file_path").alias("file"))


def delimited_names(
    spark: SparkSession, path: str, seps: tuple[str, ...] = (";", ",", "|"), min_cols: int = 5, encoding: str = "utf-8", glob: str = "*.csv"
) -> DataFrame:
    """(file, ordinal from 1, column, kind 'text', rows NULL) of all delimited files under ``path``. Empty files give no row."""

    def read(fs, name):
        with fs.open_input_stream(name) as raw:
            names = header_names(io.BufferedReader(raw), encoding, seps, min_cols)
        return names, [TEXT] * len(names), None

    return _files(spark, path, glob).mapInArrow(lambda it: _batches(it, read), NAMES_SCHEMA)


def parquet_names(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """(file, ordinal from 1, column, kind, rows of the file) of all parquet files under ``path``, from their footers."""

    def read(fs, name):
        with fs.open_input_file(name) as raw:
            footer = pq.ParquetFile(raw)
            fields = list(footer.schema_arrow)
            return [f.name for f in fields], [kind_of(f.type) for f in fields], footer.metadata.num_rows

    return _files(spark, path, glob).mapInArrow(lambda it: _batches(it, read), NAMES_SCHEMA)


def known_cells(spark: SparkSession, path: str, names: DataFrame, sep: str = ";", encoding: str = "utf-8") -> DataFrame:
    """``names`` with ``known``, the filled cells of each column of each delimited file.

    One scan reads all layouts by position; names come from the names table afterwards.
    """
    width = names.agg(F.max("ordinal")).first()[0] or 0
    cols = [f"_c{i}" for i in range(1, width + 1)]
    if not cols:
        return names.withColumn("known", F.lit(0).cast("long"))
    cells = spark.read.csv(path, sep=sep, encoding=encoding, header=True, schema=", ".join(f"{c} string" for c in cols), pathGlobFilter="*.csv")
    counts = cells.groupBy(F.col("_metadata.file_path").alias("file")).agg(*[F.count(c).alias(c) for c in cols])
    each = counts.select("file", F.posexplode(F.array(*cols)).alias("_at", "known")).select("file", (F.col("_at") + 1).alias("ordinal"), "known")
    return names.join(each, ["file", "ordinal"], "left").withColumn("known", F.coalesce("known", F.lit(0)))


def path_part(key: str) -> Column:
    """The value of a ``key=value`` folder in the path of a file, NULL without one."""
    value = F.regexp_extract("file", rf"/{key}=([^/]*)/", 1)
    return F.when(value != "", value)
