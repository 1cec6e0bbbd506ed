"""Session settings and the shared checkpoint folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus="*", memory="8g", partitions=8, app="riskflow") -> SparkSession:
    """Session for tests and the bench; on a cluster the session comes from spark-submit."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.driver.memory", memory)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shares(spark: SparkSession) -> int:
    """Number of reduce tasks the session aims at."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: the cluster's spark.checkpoint.dir.

    Only where the cluster names none (tests on one machine) a folder of our own is used.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="riskflow-")
        sc.setCheckpointDir(folder)
    return folder or sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """New, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
