"""Small driver-side files on any file system that Spark reaches: manifests, configs,
audits. Tables go through DataFrame readers and writers."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def size(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file or of all files below a directory; None if absent."""
    at, fs = _path(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else None


def names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


#: What stands before a path's first folder, a store's name included where it has one.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"


def sized(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of a file, or of all files in a folder and its folders but hidden ones."""
    at, fs = _path(spark, path)
    found, todo = [], [fs.getFileStatus(at)] if fs.exists(at) else []
    while todo:
        one = todo.pop()
        if one.isDirectory():
            todo += [s for s in fs.listStatus(one.getPath()) if s.getPath().getName()[0] not in "._"]
        else:
            found.append((one.getPath().toString(), one.getLen()))
    return sorted(found)


def below(spark: SparkSession, path: str) -> list[str]:
    """The files of ``sized`` without the scheme."""
    return sorted(re.sub(SCHEME, "/", at) for at, _ in sized(spark, path))


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _path(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _path(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def sha256(spark: SparkSession, path: str) -> str:
    """Of a file of any size, streamed within the JVM."""
    jvm = spark._jvm
    at, fs = _path(spark, path)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = jvm.java.security.DigestInputStream(fs.open(at), digest)
    try:
        stream.transferTo(jvm.java.io.OutputStream.nullOutputStream())
    finally:
        stream.close()
    return bytes(digest.digest()).hex()


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(read_text(spark, path))


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """Pretty, keys sorted, ASCII only."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=True) + "\n")
