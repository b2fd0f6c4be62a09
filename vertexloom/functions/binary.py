"""Functions of binary payloads and file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes (hex) of known payloads of at least 8 bytes.
MAGIC = (("89504E470D0A1A0A", "PNG (raw)"), ("25504446", "PDF (raw)"), ("FFD8", "JPEG (raw)"), ("62706C6973743030", "NSKeyedArchive/Plist"))
#: File kinds by extension (case-sensitive).
FILE_KINDS = {"image": ("png", "jpg", "jpeg", "gif"), "text": ("txt", "rtf", "html"), "video": ("mov", "m4v", "mp4"), "sqlite": ("sqlite", "sqlite-shm")}


def hex_header(data: Column, count: int = 8) -> Column:
    """The first ``count`` bytes as ``01 AB``."""
    return F.regexp_replace(F.hex(F.substring(data, 1, count)), "(..)(?!$)", "$1 ")


def data_kind(data: Column) -> Column:
    """The payload's kind by its leading bytes, else Unknown."""
    kind = F.lit("Unknown")
    head = F.hex(F.substring(data, 1, 8))
    for magic, name in reversed(MAGIC):
        kind = F.when((F.octet_length(data) >= 8) & F.startswith(head, F.lit(magic)), name).otherwise(kind)
    return kind


def file_type(path: Column) -> Column:
    """image, text, video, sqlite or unknown, by extension; directory for a
    path that ends with a slash."""
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    kind = F.lit("unknown")
    for name, extensions in FILE_KINDS.items():
        kind = F.when(extension.isin(*extensions), name).otherwise(kind)
    return F.when(F.endswith(path, F.lit("/")), "directory").otherwise(kind)
