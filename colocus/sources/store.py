"""Bytes of files in any store that Arrow opens, for tasks on executors; listings and moves for the driver."""

from __future__ import annotations

import os
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or a plain path, written as Hadoop writes them: nothing in them is escaped."""
    if uri.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(quote(uri, safe="/:@?=&,+~%")) if "://" in uri else (pafs.LocalFileSystem(), uri)


def open_file(uri: str) -> pa.NativeFile:
    """A seekable file; reads fetch the bytes that are asked for."""
    fs, path = store_of(uri)
    return fs.open_input_file(path)


def put_file(uri: str, data: bytes) -> None:
    """Writes a whole file under a private name, then moves it: a repeated task replaces it by equal bytes."""
    fs, path = store_of(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def hadoop(spark: SparkSession, uri: str):
    """Hadoop's file system and path of a URI, on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def listing(spark: SparkSession, uri: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of every data file under a path, in order; hidden ones are left out, as by Spark's readers."""
    fs, path = hadoop(spark, uri)
    found, files = [], fs.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        at = f.getPath().toString()
        if not any(p[:1] in "_." for p in at[len(path.toString()) :].split("/") if p):
            found.append((at, f.getLen(), f.getModificationTime()))
    return sorted(found)
