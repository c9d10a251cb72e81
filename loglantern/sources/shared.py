"""The folder all executors share, for checkpoints and written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SHARED_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names.

    Only a local session, which has no other machines, may go without: it gets
    a new temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get(SHARED_DIR, None) or context.getConf().get(SHARED_DIR)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError(f"set {SHARED_DIR} to a folder all executors can reach")
    spark.conf.set(SHARED_DIR, tempfile.mkdtemp(prefix="loglantern-"))
    return spark.conf.get(SHARED_DIR)


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
