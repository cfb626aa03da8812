"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings that the queries rely on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veritrail")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by the cluster in spark.checkpoint.dir.

    Only where the cluster names none (local runs, tests) a temporary folder is set.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='veritrail-')}")
    return jsc.getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as parquet into the shared folder and read it again: lineage ends here and
    the table outlives any executor. The schema is kept, so an empty table stays readable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veritrail/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input that are work enough for a task.
SPLIT = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores where it is read from so little that its scan would leave most of them idle, as when heavy work in
    Python follows. Larger inputs come in enough splits and aren't shuffled. The rows are the same either way."""
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= 2 * cores:
        return df
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    size = sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files)
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys) if size < 2 * cores * SPLIT else df


def clear_work(spark: SparkSession) -> None:
    """Remove the tables that materialize() and the persistent counts have left; results read from them end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/veritrail")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a context, so that they can load its functions wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_veritrail_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="veritrail-")) / "veritrail.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._veritrail_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent to the workers first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
