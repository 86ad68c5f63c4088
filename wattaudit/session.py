"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "wattaudit", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables and stream checkpoints.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``, which every executor can reach. Where that
    setting is missing, a local session (one machine, as in tests) gets a temporary folder; a cluster gets an error,
    since its executors could not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.match(r"local(\[|$)", spark.sparkContext.master):
        root = tempfile.mkdtemp(prefix="wattaudit-")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/wattaudit/{name}-{uuid.uuid4().hex}"
