"""Session helpers: build a session for tests/bench and locate the shared
checkpoint folder.

On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a
shared file system path set by the cluster).  Only when that setting is absent
(local tests, bench) do we create a scratch folder of our own.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "lectern",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with the settings the operators are tuned for (AQE on, UI off)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only if unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        path = tempfile.mkdtemp(prefix="lectern-ckpt-", dir=os.environ.get("LECTERN_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lectern`` importable on executors (UDF helpers are pickled by reference).

    Zips the package once per SparkContext and registers it with ``addPyFile``,
    which distributes it to every executor (as ``--py-files`` would).  The zip is
    written into the checkpoint folder when that is a local path, otherwise to a
    driver-side file; executors always receive it from Spark.  Failing to ship
    never fails a query (executors may have the package installed).
    """
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    try:
        pkg = os.path.dirname(os.path.abspath(__file__))
        ckpt = ensure_checkpoint_dir(spark)
        local = ckpt[len("file:"):] if ckpt.startswith("file:") else ckpt
        folder = local if "://" not in ckpt and os.path.isdir(local) else tempfile.mkdtemp(prefix="lectern-pkg-")
        target = os.path.join(folder, f"lectern-{key}.zip")
        if not os.path.exists(target):
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
                for root, _dirs, files in os.walk(pkg):
                    for f in files:
                        if f.endswith(".py"):
                            full = os.path.join(root, f)
                            z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        sc.addPyFile(target)
        _SHIPPED.add(key)
    except Exception as exc:  # noqa: BLE001
        import warnings
        warnings.warn(f"lectern: package not shipped to executors ({exc})", stacklevel=2)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder); survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def summary_rows(df: DataFrame, most: int) -> list[Row]:
    """The rows of a summary table as one aggregated row; more than ``most`` of them raise.

    For tables whose size the caller bounds (one row per cell, range, write): nothing that grows with the data is read this way.
    """
    rows = df.limit(most + 1).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).first()[0]
    if len(rows) > most:
        raise ValueError(f"a summary of more than {most} rows")
    return rows


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
