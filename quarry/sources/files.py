"""Small documents beside the data, in any store that Spark reaches."""

from __future__ import annotations

import uuid

import yaml
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """What stands in a folder, sorted; empty where there is none."""
    fs, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def modified(spark: SparkSession, path: str) -> int:
    fs, place = _at(spark, path)
    return fs.getFileStatus(place).getModificationTime()


def delete(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a document in one step: readers see the old or the new one."""
    fs, place = _at(spark, path)
    _, part = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(part, place):
        fs.delete(part, False)
        raise OSError(f"cannot write {path}")


def read_yaml(spark: SparkSession, path: str) -> dict:
    got = yaml.safe_load(read_text(spark, path))
    return got if isinstance(got, dict) else {}


def write_yaml(spark: SparkSession, path: str, document: dict) -> None:
    write_text(spark, path, yaml.safe_dump(document, sort_keys=False, allow_unicode=True))
