"""Stored values as bytes: a closed list of kinds, as tagged JSON.

Strings, numbers, booleans, null, lists and dictionaries are themselves;
dates, bytes and urls are objects with a tag.  Anything else is refused.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
from urllib.parse import ParseResult, urlparse

from ..sources.codec import TAG


class NotArchivable(TypeError):
    pass


def tagged(value):
    """``value`` as plain JSON; raises NotArchivable."""
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.UTC)
        return {TAG: "date", "value": value.timestamp()}
    if isinstance(value, (bytes, bytearray)):
        return {TAG: "data", "value": base64.b64encode(bytes(value)).decode()}
    if isinstance(value, ParseResult):
        return {TAG: "url", "value": value.geturl()}
    if isinstance(value, (list, tuple)):
        return [tagged(v) for v in value]
    if isinstance(value, dict) and all(isinstance(k, str) for k in value):
        return {k: tagged(v) for k, v in value.items()}
    raise NotArchivable(type(value).__name__)


def untagged(value):
    if isinstance(value, list):
        return [untagged(v) for v in value]
    if isinstance(value, dict):
        kind = value.get(TAG)
        if kind == "date":
            return dt.datetime.fromtimestamp(value["value"], dt.UTC).replace(tzinfo=None)
        if kind == "data":
            return base64.b64decode(value["value"])
        if kind == "url":
            return urlparse(value["value"])
        return {k: untagged(v) for k, v in value.items()}
    return value


def archive(value) -> bytes:
    return json.dumps(tagged(value), sort_keys=True).encode()


def unarchive(data: bytes):
    return untagged(json.loads(data))


def try_archive(value) -> bytes | None:
    """None for what can't be archived."""
    try:
        return archive(value)
    except NotArchivable:
        return None


def try_unarchive(data: bytes | None):
    """None for what can't be read."""
    try:
        return None if data is None else unarchive(data)
    except (ValueError, KeyError, TypeError):
        return None
