"""Helpers for local files, on the driver; ``listing`` is for many files."""

from __future__ import annotations

import filecmp
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import FILE_KINDS, file_type


def exists(path: str) -> bool:
    return Path(path).exists()


def equal(a: str, b: str) -> bool:
    return Path(a).is_file() and Path(b).is_file() and filecmp.cmp(a, b, shallow=False)


def writable(path: str) -> bool:
    return os.access(path, os.W_OK)


def remove(path: str) -> None:
    shutil.rmtree(path) if Path(path).is_dir() else Path(path).unlink()


def make_folder(path: str, parents: bool = True) -> None:
    Path(path).mkdir(parents=parents)


def contents(path: str, hidden: bool = True) -> list[str]:
    return sorted(str(p) for p in Path(path).iterdir() if hidden or not p.name.startswith("."))


def write(folder: str, name: str, text: str) -> str:
    target = Path(folder) / name
    target.write_text(text)
    return str(target)


def read(path: str) -> str:
    return Path(path).read_text()


def save_payload(folder: str, name: str, data: bytes, kind: str) -> str:
    """Write an image's or document's stored bytes as ``name.kind``."""
    target = Path(folder) / f"{name}.{kind}"
    target.write_bytes(data)
    return str(target)


def kind_of(path: str) -> str:
    if Path(path).is_dir():
        return "directory"
    extension = Path(path).suffix[1:]
    return next((k for k, names in FILE_KINDS.items() if extension in names), "unknown")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, kind) of every file below a folder, without their bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length", file_type(F.col("path")).alias("kind"))
