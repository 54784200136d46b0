"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "segspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle sizing is left to adaptive execution: it merges small partitions and splits
    skewed ones, so one setting serves a laptop and a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # No call-site capture per column expression: plans here are built from many of them.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_base: dict[str, str] = {}


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a folder of its own, which goes when Python ends. Any other
    master is refused: its machines would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master!r} share")
        if master not in _own_base:
            _own_base[master] = tempfile.mkdtemp(prefix="segspark-")
            atexit.register(shutil.rmtree, _own_base[master], ignore_errors=True)
        base = _own_base[master]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
