"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Results are in UTC, adaptive execution re-plans skewed joins, and Arrow carries batches to Python.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(app: str = "stancelake", **conf: str) -> SparkSession:
    """A session with SETTINGS; keyword names use __ for a dot (spark__master="local[4]")."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """The Parquet table `name` of a data folder; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests on one machine, a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = context._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="checkpoints-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(rows: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint: they survive lost executors and are the same at each reading."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def files(spark: SparkSession, path: str):
    """(Hadoop path, its file system) of any path that Spark can read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def holds_rows(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder with more in it than what an unfinished write leaves."""
    at, system = files(spark, path)
    return system.exists(at) and any(not s.getPath().getName().startswith(("_", ".")) for s in system.listStatus(at))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is not read again."""
    at, system = files(spark, path)
    system.delete(at, True)


def unused(rows: DataFrame, wanted: str) -> str:
    """`wanted`, with as many underscores behind it as it takes to clash with no column, whatever the case."""
    low = {name.lower() for name in rows.columns}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def spread(rows: DataFrame) -> DataFrame:
    """The same rows, dealt evenly to all cores if they come in fewer partitions than there are cores.

    A Parquet file of one row group is read by one task, however dear the work on its texts. Rows of more partitions
    than cores stay as they are, so a large input is not shuffled. Select the columns that are needed before.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def texts(spark: SparkSession, sf_dir: str, *columns: str, name: str = "documents") -> DataFrame:
    """These columns of a table of texts, spread for work that is dear for each row."""
    return spread(table(spark, sf_dir, name).select(*columns))
