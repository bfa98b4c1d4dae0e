"""Session settings and the shared scratch location."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app_name: str = "skyfold") -> SparkSession:
    """Session for tests and the benchmark; on a cluster these settings come from the deployment."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared location the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose tasks run on the driver's machine, may fall back to a temporary folder. Folders
    are gathered by application, so that a deployment can remove ``<shared>/skyfold-<application id>`` when the
    application has ended; results are read lazily, hence no earlier removal.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="skyfold-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    application = spark.conf.get("spark.app.id", "session")
    return f"{shared.rstrip('/')}/skyfold-{application}/{uuid.uuid4().hex}"


def written_table(frame: DataFrame, **options: int) -> DataFrame:
    """The rows of ``frame``, written to a new scratch folder and read again: computed once, lineage cut."""
    path = scratch_dir(frame.sparkSession)
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
