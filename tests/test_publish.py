"""Publishing by manifest: unchanged parts are skipped, and a failed write leaves the old table."""

import os

import pytest
from pyspark.sql import functions as F

from annalis.sources import stages


def table(spark, rows):
    return spark.createDataFrame(rows, "year int, e int, v double")


def rows_of(spark, path):
    return sorted(tuple(r) for r in stages.read_published(spark, path).collect())


def test_only_changed_years_are_written(spark, tmp_path):
    path, rows = str(tmp_path / "p"), [(y, e, e / 4) for y in (2019, 2020, 2021) for e in range(20)]
    assert stages.publish_parts(table(spark, rows), path, "year") == ["2019", "2020", "2021"]
    folders = {p: m["folder"] for p, m in stages.read_manifest(spark, path).items()}
    assert stages.publish_parts(table(spark, rows[::-1]).repartition(5), path, "year") == []  # the order of rows says nothing
    changed = [(y, e, v + (y == 2020 and e == 3)) for y, e, v in rows if y > 2019] + [(2022, 1, None), (None, 1, 1.0)]
    assert stages.publish_parts(table(spark, changed), path, "year") == ["2020", "2022", "None"]
    now = stages.read_manifest(spark, path)
    assert now["2021"]["folder"] == folders["2021"] and now["2020"]["folder"] != folders["2020"] and "2019" not in now
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, stages.read_published(spark, path).collect()), key=key) == sorted(changed, key=key)


def test_repeated_rows_count(spark, tmp_path):
    path = str(tmp_path / "p")
    stages.publish_parts(table(spark, [(1, 1, 1.0), (1, 2, 2.0)]), path, "year")
    assert stages.publish_parts(table(spark, [(1, 1, 1.0), (1, 1, 1.0), (1, 2, 2.0)]), path, "year") == ["1"]
    assert len(rows_of(spark, path)) == 3


def test_failed_write_keeps_the_old_version(spark, tmp_path):
    path, rows = str(tmp_path / "p"), [(1, 1, 1.0), (2, 2, 2.0)]
    stages.publish_parts(table(spark, rows), path, "year")
    before = stages.read_manifest(spark, path)
    # the pass over the rows stops at the second one
    torn = table(spark, [(1, 5, 5.0), (2, 6, 6.0)]).withColumn("v", F.when(F.col("e") == 6, F.raise_error("stopped").cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stopped"):
        stages.publish_parts(torn, path, "year")
    assert stages.read_manifest(spark, path) == before and rows_of(spark, path) == rows


def test_failed_switch_keeps_the_old_version(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "p"), [(1, 1, 1.0)]
    stages.publish_parts(table(spark, rows), path, "year")
    monkeypatch.setattr(stages, "switch_manifest", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        stages.publish_parts(table(spark, [(1, 9, 9.0)]), path, "year")
    assert rows_of(spark, path) == rows
    assert sum(n.startswith("data-") for n in os.listdir(path)) == 2  # written, but named by no manifest


def test_nothing_published(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        stages.read_published(spark, str(tmp_path / "none"))
