"""Session defaults the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quantflume", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides anything."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all of a cluster's machines share: the context's checkpoint folder, or what ``spark.checkpoint.dir`` names.

    A temporary folder serves a local master only; elsewhere every machine would have its own, so that is an error.
    """
    import tempfile

    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="quantflume-")


def written(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder: what is read more than once, or would make a long plan, is computed once."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that they need no installation of it."""
    import shutil
    import tempfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_quantflume_shipped", False):
        return
    root = Path(__file__).resolve().parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quantflume-')}/quantflume", "zip", root.parent, root.name)
    sc.addPyFile(made)
    sc._quantflume_shipped = True
