"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def pin_session(spark: SparkSession, zone: str = "UTC") -> SparkSession:
    """Fix the settings results depend on; leave resource sizing to the cluster.

    The zone decides how zone-less station clocks become instants. ANSI mode
    stays as the caller set it: every cast that may fail is a ``try_cast``.
    """
    spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would not be visible to other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    import tempfile

    own = tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder: survives the loss of executors.

    Iterative training reads its rows many times; a checkpoint keeps the plan
    short and the upstream work done once.
    """
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)
