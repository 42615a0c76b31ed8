"""Intermediate tables: written, read again, and removed."""

import os

from pyspark.sql import functions as F

from sparkloom.llm import common


def test_written_tables_can_be_removed(spark):
    before = list(common._MADE)
    common._MADE.clear()
    try:
        df = common.written(spark.range(10).groupBy(F.col("id") % 3).count(), "t")
        path = common._MADE[-1].removeprefix("file://")
        assert df.count() == 3 and os.path.isdir(path)
        assert common.clean() == 1 and not os.path.exists(path) and common.clean() == 0
    finally:
        common._MADE.extend(before)


def test_settings_come_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with common.setting(spark, key, "true"):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
