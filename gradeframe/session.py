"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job wants at any scale: adaptive execution re-plans joins from
# measured sizes (runtime broadcast only under the threshold), coalesces small
# shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows here are texts with CPU-heavy per-row work: let small inputs keep
    # one partition per core (no effect once partitions are large anyway)
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches for the Python step hold whole texts as token lists; a
    # 20,000-word document is ~1-2 MB of Python objects, so batches stay small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "gradeframe", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's session and
    ``apply_scale_conf``; nothing here is required for correctness."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("GRADEFRAME_DRIVER_MEMORY", "8g")))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def apply_scale_conf(spark: SparkSession) -> None:
    for k, v in SCALE_CONF.items():
        spark.conf.set(k, v)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset *and* the master is local
    (tests) a private folder is created and registered. On a cluster an
    unset setting is an error, never a machine-local fallback.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf_dir = None
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder every executor shares "
                               "(HDFS / object store); a machine-local folder would lose written tables")
        conf_dir = tempfile.mkdtemp(prefix="gradeframe-ckpt-")
    sc.setCheckpointDir(conf_dir)
    d = sc.getCheckpointDir() or conf_dir
    return d.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/gradeframe/{label}-{uuid.uuid4().hex[:12]}"



def spread(df: DataFrame) -> DataFrame:
    """Round-robin a *scan-level* DataFrame over all cores when it has fewer
    partitions than the cluster has task slots (a small file read as a
    handful of splits before CPU-heavy per-row work). On large inputs the
    scan already has more splits than slots and this is a no-op."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gradeframe`` importable in the Python workers of this context
    (Arrow UDFs and ``mapInPandas`` functions live in it): zip the package
    once and ``addPyFile`` it, as ``spark-submit --py-files`` would."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="gradeframe-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "gradeframe"), "zip", os.path.dirname(pkg), "gradeframe")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
