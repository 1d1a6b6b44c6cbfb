"""Session builder with the settings the library expects."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import SparkSession


def get_session(app: str = "tidepool", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a session that runs already is kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where none is set, a local session gets a new folder that goes when Python ends; a session on a cluster is refused, since its executors would write to disks of their own."""
    import atexit
    import shutil
    import tempfile

    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else ""
    if not found:
        if not context._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="tidepool-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own below the shared folder; `sweep` deletes what was written there."""
    import os
    import uuid

    path = os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")
    context = spark.sparkContext
    context._tidepool_paths = [*getattr(context, "_tidepool_paths", []), path]
    return path


def sweep(spark: SparkSession) -> int:
    """Deletes all folders that this session has written below the shared one; results that are read from them have to be used up or stored by then. The number of folders."""
    context = spark.sparkContext
    paths = getattr(context, "_tidepool_paths", [])
    for path in paths:
        remove(spark, path)
    context._tidepool_paths = []
    return len(paths)


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written below the shared folder within it; for work whose result is stored elsewhere by then."""
    context = spark.sparkContext
    before = getattr(context, "_tidepool_paths", [])
    yield
    for path in getattr(context, "_tidepool_paths", [])[len(before) :]:
        remove(spark, path)
    context._tidepool_paths = before


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written below the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, so that Python workers find it wherever they run."""
    import os
    import tempfile
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_tidepool_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidepool-"), "tidepool.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._tidepool_shipped = True
