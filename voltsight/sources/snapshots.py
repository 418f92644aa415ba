"""Dataset refresh by versioned snapshots.

A dataset folder holds one folder per version under ``data`` and one small manifest
per version under ``manifests``.  A refresh validates the columns, writes the new
version beside the old ones, reads back its row count, and only then publishes its
manifest by a rename; readers take the newest manifest.  A rejected or failed refresh
therefore leaves what readers see as it was, a reader that has begun keeps its files
(the last ``keep`` versions stay), and a new version may be derived from the current
one.  Two refreshes at once can't publish the same version: the second one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

_MANIFEST = "version bigint, folder string, n_rows bigint, columns array<string>"


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """Published versions, or None if there are none yet."""
    fs, hadoop_path = _fs(spark, path)
    found = hadoop_path(f"{path}/manifests")
    if not fs.exists(found) or not any(s.getPath().getName().endswith(".json") for s in fs.listStatus(found)):
        return None
    return spark.read.schema(_MANIFEST).json(f"{path}/manifests/*.json")


def newest(spark: SparkSession, path: str):
    """The newest published manifest, or None."""
    own = manifests(spark, path)
    return None if own is None else own.orderBy(F.desc("version")).first()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The dataset as last published."""
    m = newest(spark, path)
    if m is None:
        raise FileNotFoundError(f"no snapshot in {path}")
    return spark.read.parquet(f"{path}/data/{m.folder}")


def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
    fs, hadoop_path = _fs(spark, path)
    final = hadoop_path(f"{path}/manifests/{manifest['version']:012d}.json")
    draft = hadoop_path(f"{path}/manifests/_{manifest['folder']}")
    if fs.exists(final):
        raise RuntimeError(f"version {manifest['version']} of {path} was published meanwhile")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(draft, final):
        raise RuntimeError(f"version {manifest['version']} of {path} could not be published")


def refresh(new: DataFrame, path: str, required=C.REQUIRED_COLUMNS, keep: int = 2) -> dict:
    """Replace the dataset by ``new`` if it has all ``required`` columns.

    Returns ``{"replaced", "missing", "version", "n_rows"}`` of what readers now see
    (version None if there is nothing yet).  An error while writing is raised after
    the unfinished folder is removed; the published version stays.
    """
    spark = new.sparkSession
    fs, hadoop_path = _fs(spark, path)
    before = newest(spark, path)
    missing = [c for c in required if c not in new.columns]
    if missing:
        return {"replaced": False, "missing": missing, "version": before and before.version, "n_rows": before and before.n_rows}
    version = (before.version if before else 0) + 1
    folder = f"v{version:012d}-{uuid.uuid4().hex}"
    try:
        new.write.parquet(f"{path}/data/{folder}")
        n = spark.read.parquet(f"{path}/data/{folder}").count()
        _publish(spark, path, {"version": version, "folder": folder, "n_rows": n, "columns": new.columns})
    except Exception:
        fs.delete(hadoop_path(f"{path}/data/{folder}"), True)
        raise
    for old in manifests(spark, path).where(F.col("version") <= version - max(keep, 1)).collect():
        fs.delete(hadoop_path(f"{path}/manifests/{old.version:012d}.json"), False)
        fs.delete(hadoop_path(f"{path}/data/{old.folder}"), True)
    return {"replaced": True, "missing": [], "version": version, "n_rows": n}
