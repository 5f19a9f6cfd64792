"""Where a job may write tables of its own."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder the session names.

    Only a session that runs in one process (``local`` or ``local[...]``) may go without
    ``spark.checkpoint.dir``: it gets a folder of this machine that is deleted on exit. On a
    cluster, a local one too, other processes could not read it, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/hubtrace-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="hubtrace-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
