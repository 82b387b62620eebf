"""Session, shared folder and table access used by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "lavra", **conf: str) -> SparkSession:
    """Session for tests and benches. A cluster brings its own session and settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LAVRA_DRIVER_MEMORY", "6g"))
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the session names it in spark.checkpoint.dir.

    Only where the session names none (tests, local runs) a local folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
    made = "file://" + tempfile.mkdtemp(prefix="lavra-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    remember(spark, path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remember(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if not hasattr(sc, "_lavra_written"):
        sc._lavra_written = []
        atexit.register(discard, spark)
    sc._lavra_written.append(path)


def discard(spark: SparkSession) -> int:
    """Delete the intermediate tables of this session, as also happens when the driver's Python ends; how many there were."""
    sc = spark.sparkContext
    paths, sc._lavra_written = getattr(sc, "_lavra_written", []), []
    for path in paths:
        try:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            pass  # the JVM has gone, or the folder has
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, tasks_per_core: int = 2) -> DataFrame:
    """Give CPU-heavy Python stages enough tasks: repartition only where the scan yields fewer tasks than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * tasks_per_core)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python workers anywhere can import it."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_lavra_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lavra-"), "lavra_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._lavra_shipped = True
