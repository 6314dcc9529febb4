"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gristmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults: AQE, UTC, Kryo-free plain settings. Explicit `conf` wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.ui.showConsoleProgress": "false",
        # Checkpoints go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


@contextlib.contextmanager
def interactive(spark: SparkSession, partitions: int = 2) -> Iterator[None]:
    """Settings for single searches on an index in memory, where scheduling outweighs the work: few shuffle partitions, no
    adaptive planning. Those of the session come back afterwards."""
    few = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder for intermediate data that all executors share, `spark.checkpoint.dir`; None where it is unset on one machine."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder the cluster names.

    The folder is `spark.checkpoint.dir`; only where it is unset, as in tests on one machine, a
    temporary folder is taken. The checkpoint is a full copy on shared storage, so a lost executor
    costs nothing but a re-read.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession) or tempfile.mkdtemp(prefix="gristmill-checkpoint-"))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that nothing need be installed on them."""
    sc = spark.sparkContext
    if getattr(sc, "_gristmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gristmill-code-")) / "gristmill.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._gristmill_shipped = True
