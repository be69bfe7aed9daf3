"""A set of tables written together: Parquet under a version's folder, and a manifest that names it, written last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_dataset(spark: SparkSession, path: str, tables: dict[str, DataFrame], by: dict[str, list[str]] | None = None) -> int:
    """Write all tables as a new version of the set at ``path``; returns its number, from 1.

    Tables go to a folder of their own, in folders by the columns of ``by``. The manifest, which lists
    them with their schemas, is written beside its place and renamed into it when all are there, so a
    reader sees the version before or this one whole. A writer that dies leaves files that no manifest
    names. Two writers can't take one number: the rename of the second fails, and it raises.
    """
    version = max(versions(spark, path), default=0) + 1
    folder = f"v{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.partitionBy(*(by or {}).get(name, [])).parquet(f"{path}/{folder}/{name}")
    listed = {"folder": folder, "tables": {name: df.schema.json() for name, df in tables.items()}}
    system, draft = _system(spark, f"{path}/{MANIFESTS}/.{folder}")
    out = system.create(draft)
    out.write(bytearray(json.dumps(listed).encode()))
    out.close()
    _, place = _system(spark, f"{path}/{MANIFESTS}/{version:08d}.json")
    if system.exists(place) or not system.rename(draft, place):
        system.delete(draft, False)
        raise FileExistsError(f"version {version} of {path} was written by another writer")
    return version


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of the set, in order."""
    system, at = _system(spark, f"{path}/{MANIFESTS}")
    if not system.exists(at):
        return []
    names = (s.getPath().getName() for s in system.listStatus(at))
    return sorted(int(n[:8]) for n in names if n.endswith(".json") and not n.startswith("."))


def read_dataset(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version of the set, its last one if none is named."""
    from pyspark.sql.types import StructType

    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{path} has no {'version' if version is None else f'version {version}'}")
    text = spark.read.text(f"{path}/{MANIFESTS}/{version or known[-1]:08d}.json").first()[0]
    listed = json.loads(text)
    return {name: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/{listed['folder']}/{name}") for name, schema in listed["tables"].items()}
