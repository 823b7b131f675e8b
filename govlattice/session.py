"""Session defaults and small I/O helpers shared by every module."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only settings that change results or let Spark re-plan at run time; sizing
# (executors, memory, shuffle partitions) belongs to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "govlattice", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the result-relevant defaults on a session somebody else created."""
    for key in ("spark.sql.session.timeZone",):
        spark.conf.set(key, DEFAULTS[key])
    return spark


# Tables whose rows are expensive to process for their size.
HEAVY_TABLES = ("documents", "pages", "conversations", "orders")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return spread(df) if name in HEAVY_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-bound work on an input with few partitions.

    A file with one row group is one task, however many cores are free. Only an
    input with fewer partitions than cores is redistributed, which is small by
    that very fact; a large input is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster, or a scratch one if unset.

    ``spark.checkpoint.dir`` is read first; the temporary folder is only for
    single-machine sessions (tests, notebooks) that name none.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    target = configured
    if not target:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        target = tempfile.mkdtemp(prefix="govlattice-ckpt-")
    sc.setCheckpointDir(target)
    return target


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and go on from the files.

    The files outlive any executor, so nothing before them is ever computed
    again; unlike an eager ``checkpoint()`` the last stage runs only once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/govlattice-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Bring a rule-sized table to the driver, refusing anything larger.

    Rule tables become literals of the plan, so their size must be proven
    small. One row more than ``limit`` is asked for: that is enough to notice
    an oversized table without pulling it.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, too large to hold as literals")
    return rows
