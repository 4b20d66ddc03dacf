"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "textlabel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; anything in `conf` (dots as `__`) wins.

    Sizes that depend on the cluster (executors, memory, shuffle partitions) are left to
    spark-submit, so the same code runs on a laptop and on a thousand executors.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    defaults.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only where the cluster names none and the master is local (tests, a laptop) is a temporary
    folder made; on a real cluster a machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="textlabel-")
    return _LOCAL_FOLDERS[context.applicationId]


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, even: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors,
    and gives later joins true file sizes to plan with.

    `even` first evens out partitions to the advisory size. That is one shuffle of a narrow table, paid
    back where many passes follow, as in the iterations of a model fit.
    """
    path = new_table_path(df.sparkSession, label)
    (df.hint("rebalance") if even else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
