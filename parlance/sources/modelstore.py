"""Versioned model bundles in the shared folder.

A version is a folder ``<root>/v000001`` with one saved pipeline per name. It is
written under another name and renamed when whole, so a reader never sees part of
one. One publisher at a time is assumed (a second one's rename would fail).
"""

from __future__ import annotations

import re
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first; none where nothing was published."""
    store, path = _store(spark, root)
    if not store.exists(path):
        return []
    names = [f.getPath().getName() for f in store.listStatus(path)]
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d{6,}", n))


def publish(spark: SparkSession, root: str, models: dict[str, PipelineModel]) -> int:
    """Write the models as the next version; its number."""
    version = max(versions(spark, root), default=0) + 1
    draft = f"{root}/draft-{uuid.uuid4().hex[:12]}"
    for name, model in models.items():
        model.write().save(f"{draft}/{name}")
    store, target = _store(spark, f"{root}/v{version:06d}")
    if store.exists(target) or not store.rename(spark._jvm.org.apache.hadoop.fs.Path(draft), target):
        raise RuntimeError(f"version {version} of {root} was published meanwhile")
    return version


def load(spark: SparkSession, root: str, names, version: int | None = None) -> tuple[int, dict[str, PipelineModel]]:
    """(version, models by name); the newest version unless one is asked for."""
    version = version or max(versions(spark, root), default=None)
    if version is None:
        raise FileNotFoundError(f"no model published in {root}")
    return version, {name: PipelineModel.load(f"{root}/v{version:06d}/{name}") for name in names}
