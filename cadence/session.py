"""Session helpers: a local session for tests/bench and a shared scratch folder.

Scratch data (written reports, store tables) goes under the folder the cluster
names in ``spark.checkpoint.dir``. Only a local master without that setting
gets a private temporary folder, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "cadence") -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CADENCE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    When it is unset on a local master (tests, bench) a private folder is
    created and registered; on a cluster an unset value is an error, because
    a machine-local folder is not visible to the executors.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before writing scratch tables")
    root = tempfile.mkdtemp(prefix="cadence-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder path under the shared checkpoint root; ``drop_scratch`` removes it."""
    path = f"{checkpoint_root(spark)}/cadence/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``DataFrame.checkpoint`` has a (shared) folder to write to."""
    root = checkpoint_root(spark)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(sc._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _hadoop(spark, path)
    return bool(fs.exists(jpath))


_MADE: dict[str, list[str]] = {}


def drop_scratch(spark: SparkSession) -> int:
    """Remove the scratch folders that this application has made; call it when no plan reads them any more."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        fs, jpath = _hadoop(spark, path)
        fs.delete(jpath, True)
    return len(made)


def materialize(df, name: str = "materialized"):
    """Run ``df`` once and cut its lineage with a written table.

    Used for small intermediate results that several consumers of one plan
    read (e.g. per-entity period counts): the expensive scan/join below them
    runs exactly once, in one job (``DataFrame.checkpoint`` would recompute
    the plan to write it). The Parquet files live in the shared checkpoint
    folder, so they survive a lost executor, and the read-back plan gets real
    size statistics for Spark's broadcast decisions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known schema: no footer-inference job


_SHIPPED: set[tuple[str, str]] = set()
_ZIP: tuple[bytes, str] | None = None


def _package_zip() -> tuple[bytes, str]:
    """The package's .py files as a zip (built once per process) and its digest."""
    global _ZIP
    if _ZIP is None:
        import hashlib
        import io
        import zipfile

        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
            for root, _dirs, files in sorted(os.walk(pkg_dir)):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        arc = os.path.join("cadence", os.path.relpath(full, pkg_dir))
                        with open(full, "rb") as fh:
                            zf.writestr(zipfile.ZipInfo(arc, date_time=(2020, 1, 1, 0, 0, 0)), fh.read())
        data = buf.getvalue()
        _ZIP = (data, hashlib.sha1(data).hexdigest()[:16])
    return _ZIP


def ship_package(spark: SparkSession) -> None:
    """Make the ``cadence`` package importable in executor Python workers.

    Functions that run in Python workers (``mapInPandas``) are pickled by
    reference, so executors must be able to import this package. Zips the
    package once per application into the shared checkpoint folder and adds it
    with ``addPyFile`` (the standard way to ship a library to executors).
    """
    sc = spark.sparkContext
    data, digest = _package_zip()
    key = (sc.applicationId, digest)
    if key in _SHIPPED:
        return
    path = f"{checkpoint_root(spark)}/cadence-pkg-{digest}.zip"
    if not path_exists(spark, path):  # always through Hadoop, whatever file system the folder is on
        fs, jpath = _hadoop(spark, path)
        out = fs.create(jpath)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(path)
    _SHIPPED.add(key)
