"""Session settings that every plan here expects, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, **options: str) -> SparkSession:
    """A session with adaptive execution, ANSI semantics and UTC; ``options`` use _ for the dots of setting names."""
    builder = SparkSession.builder.appName("cartulary")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    settings |= {name.replace("_", "."): value for name, value in options.items()}
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that cut a lineage: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a temporary folder if there is only this machine; on a cluster that is an error, because the
    executors could not read it or would lose it.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    chosen = spark._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir, or the context's checkpoint folder, to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="cartulary-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
