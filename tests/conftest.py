import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


LOG = "source string, ts bigint, seq bigint, structured boolean, raw_data string, indexes array<string>, json_keys array<string>"


@pytest.fixture(scope="session")
def log_table(spark):
    def make(rows):
        full = [(r.get("source", "a"), r.get("ts", 0), r.get("seq", i), r.get("structured", False), r.get("raw_data", ""), r.get("indexes"), r.get("json_keys")) for i, r in enumerate(rows, 1)]
        return spark.createDataFrame(full, LOG)

    return make
