"""Session helpers: defaults, the shared scratch folder, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROW_BOUND = 200_000
_SHIPPED: set[str] = set()  # applications whose workers have the package
_LOCAL_ROOTS: dict[str, str] = {}  # folders of local sessions without the setting


def build_session(master: str = "local[*]", app: str = "calibra", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = root = tempfile.mkdtemp(prefix="calibra-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)  # a local session's own folder ends with it
    return _LOCAL_ROOTS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def keep_checkpoints(spark: SparkSession) -> None:
    """Give the session a folder for checkpoints where none is set.

    A fit of hundreds of rounds cuts the lineage of its rows there; uncut, it
    grows with each round until tasks overflow the stack when they read it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(spark, "checkpoints"))


def checked_side(df: DataFrame, name: str = "side") -> DataFrame:
    """A small table written once and counted; broadcast when the count is in bound.

    For join sides whose size is not known before they are computed. The count
    keeps the other side from being shuffled, and above the bound the join
    stays a plain one.
    """
    table = materialize(df, name)
    return small_side(table, table.count())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with data that outlives any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bound: float | None) -> DataFrame:
    """Hint a broadcast only when the row count has a proven small bound.

    Without a bound the planner decides from the measured size at run time.
    """
    if row_bound is not None and row_bound <= BROADCAST_ROW_BOUND:
        return F.broadcast(df)
    return df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in Python tasks refer to their modules. Spark serves the
    archive to every executor, so none has to have the package installed.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="calibra-")) / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, file.relative_to(home.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
