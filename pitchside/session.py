"""Session helpers: a local session for tests/bench and the shared scratch root."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "pitchside") -> SparkSession:
    """A local session configured like a small cluster (AQE on, UTC, no UI)."""
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PITCHSIDE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Settings every job relies on; safe to call on a cluster session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # HotSpot leaves methods of more bytecodes uncompiled; such a stage (normalisation, rendering)
    # runs by its split-up projections instead, in about half the CPU time
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    scratch_root(spark)


def app_id(spark: SparkSession) -> str:
    """The application id (classic sessions) or the session's ``spark.app.id``."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # e.g. a Spark Connect session has no SparkContext
        return spark.conf.get("spark.app.id", None) or spark.conf.get("spark.app.name", "pitchside")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may do without the setting (tests, local bench): there
    a fresh folder is made. On a cluster a machine's own folder would not be
    seen by the other machines, so a missing setting is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect has no SparkContext: only the setting counts
        return _given(spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")).rstrip("/")
    root = sc.getCheckpointDir() or _given(sc.getConf().get("spark.checkpoint.dir", None), sc.master)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return (sc.getCheckpointDir() or root).rstrip("/")


def _given(root: str | None, master: str) -> str:
    if root:
        return root
    if re.fullmatch(r"local(\[[^\]]*\])?", master):
        return tempfile.mkdtemp(prefix="run-", dir="/tmp")
    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def materialise(df, label: str):
    """Write a small step once under the shared scratch root and read it back:
    what several branches of a plan need is computed once, and Spark knows how
    small it is."""
    path = scratch_path(df.sparkSession, "steps", f"{label}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([scratch_root(spark), *parts])
