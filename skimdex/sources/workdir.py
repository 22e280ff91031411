"""Where the registered queries keep the tables they index: the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_made: dict[str, str] = {}


def workdir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode without one, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if root:
        return f"{root.rstrip('/')}/skimdex-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="skimdex-")
    return _made[app]
