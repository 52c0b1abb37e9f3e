"""Where a job may write data that it reads back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _local_root() -> str:
    """One temporary folder for this process, deleted when it ends."""
    root = tempfile.mkdtemp(prefix="trolley-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path ending in ``name`` in the shared folder of ``spark.checkpoint.dir``.

    Each call gives another path: a DataFrame may still be reading what an earlier call wrote.
    Without that setting only a local session gets a temporary folder, which goes when the
    process ends; on a cluster such a folder would exist on one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/trolley/{uuid.uuid4().hex}/{name}"
