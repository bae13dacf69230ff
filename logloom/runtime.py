"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine, as in tests, makes a temporary folder and
    keeps it in its settings; on a cluster, whose machines would each have their own, it fails.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_WRITTEN: list[str] = []


def scratch(spark: SparkSession, what: str = "table") -> str:
    """A new path in the shared folder; what lies there goes with ``clean``, at the latest when
    the process ends."""
    if not _WRITTEN:
        atexit.register(clean, spark)
    _WRITTEN.append(f"{shared_dir(spark)}/logloom-{what}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables. Results that read from them must have been written before."""
    try:
        for path in _WRITTEN:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session has ended: whoever owns the folder cleans it
        return
    finally:
        _WRITTEN.clear()
        atexit.unregister(clean)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Later jobs start from the written files, so that neither a lost executor nor a second use
    computes the plan above again; being columnar, they also allow column pruning.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_names(paths: list[str]) -> list[str]:
    """A column name of its own for every path: other characters as _, unique without regard to case."""
    out: list[str] = []
    taken = set()
    for p in paths:
        base = "f_" + re.sub(r"\W", "_", p)
        name, k = base, 2
        while name.lower() in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name.lower())
        out.append(name)
    return out
