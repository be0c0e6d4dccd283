"""Session defaults for tests and benches; on a cluster the job brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session on one machine; ``shared`` names the folder of intermediate tables."""
    builder = SparkSession.builder.config("spark.checkpoint.dir", shared) if shared else SparkSession.builder
    return (
        builder.master(f"local[{cores}]")
        .appName("ledgerfold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    It is the cluster's to name, in ``spark.checkpoint.dir`` or by
    ``setCheckpointDir``.  None is made up here: a folder of one machine would
    be unseen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder


#: Bytes of rows that go to a Python worker at once, where the session sets no limit of its own.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, and rows to them in small batches.

    For steps whose functions run on executors that have no copy installed.  A
    batch stands several times over in an executor, beside every worker: by
    Spark's own limits, 10,000 texts or 64 MB each time.
    """
    if spark.conf.get(BATCH_LIMIT, "1b") == "1b":
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_ledgerfold_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerfold-"), "ledgerfold.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("ledgerfold", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._ledgerfold_shipped = True


def cut(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from the written table.

    The lineage ends there, so a lost executor costs a read of the table; and
    its size is known from then on, so Catalyst broadcasts it if it is small
    and shuffles it if it is not.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/ledgerfold/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def written_folders(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Complete tables ``path/name=N`` by their number, from any store Spark reads."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return {}
    found = {}
    for status in store.listStatus(root):
        folder = status.getPath()
        left, _, number = folder.getName().partition("=")
        if left == name and number.isdigit() and store.exists(folder.suffix("/_SUCCESS")):
            found[int(number)] = folder.toString()
    return found


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
