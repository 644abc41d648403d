"""Session construction and the shared scratch area used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quire", master: str | None = None, partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """A session with the settings the library is tuned for; anything the caller's environment sets wins."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (a local session, as in tests) a temporary folder is made and
    set as checkpoint folder, so later calls find the same one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made_here = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, made_here, ignore_errors=True)
    folder = f"file://{made_here}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Written tables in the shared folder; each cuts the lineage and survives the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
        self._made: dict[str, list[str]] = {}
        self._count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as parquet and read again with the schema it had."""
        path = f"{self.base}/{self._count:04d}-{name}"
        self._count += 1
        schema = df.schema
        df.write.parquet(path)
        self._made.setdefault(name, []).append(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str, keep: int = 0) -> None:
        """Delete the tables of these names, all but the last ``keep`` of each. Only for tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            paths = self._made.get(name, [])
            gone, self._made[name] = paths[: len(paths) - keep], paths[len(paths) - keep :]
            for path in gone:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
