"""Where intermediate tables go: the shared folder the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset, a local session uses its warehouse folder. A cluster
    session is refused: its warehouse is not made for passing data.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {_SETTING} to storage that every executor can reach")
    return spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path that :func:`new_workspace` gave."""
    if f"{shared_folder(spark)}/weirline/" not in path:
        raise ValueError(f"{path} is not a workspace of this session")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def new_workspace(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses. It is not created."""
    return f"{shared_folder(spark)}/weirline/{label}-{uuid.uuid4().hex}"
