"""Media columns as content-defined chunks.

A text's payload is cut where a rolling gear hash of the last 32 bytes meets a
mask, so equal passages give equal chunks wherever they stand.  A payload is
stored as its ordered chunk list (digest and length of each chunk); chunk
digests are deduplicated by Spark over the whole corpus.  Chunks that occur
once stay in their document's row; chunks that occur more often live once in a
chunk table, and documents that hold such chunks are put together again by
joining their lists with it.  Whatever is read back is checked against its
digests before features are taken.

Layout and size: every document's form and own chunks are written with its
row, and facts come from a second pass over the rows as read again.  Only
digests are shuffled for all chunks; bytes move for documents with repeated
chunks alone.  The set of repeated digests goes to the
tasks by broadcast while it has at most ``broadcast_rows`` rows, and beyond
that documents learn their repeated chunks by a join.

Defined results: a null text is an empty one; the empty text's payload is one
unit of padding.  Equal texts give equal values; rows are not merged, whatever
their ids.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_batches
from .textvec import mix

GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: The stored form starts with this; then come digest (32 bytes) and length (4, little-endian) of each chunk.
MAGIC = b"VLCL1\0"
ENTRY = "<32sI"


def payload_of(text: str | None, unit: int) -> tuple[int, bytes]:
    """Length of the text's UTF-8 bytes, and these with bytes 255 up to a
    positive multiple of ``unit``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % unit if raw else unit)


def cuts(data: bytes, bits: int = 10, least: int = 256, most: int = 8192) -> list[int]:
    """Ends of the chunks of ``data``: where the gear hash of the last 32
    bytes has ``bits`` leading zeros, at least ``least`` and at most ``most``
    bytes after the last end; and the end of the data."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):  # hash of the last 2 * width bytes from two hashes of width bytes
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    found = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    ends, last = [], 0
    for end in [*found, len(data)]:
        while end - last > most:
            last += most
            ends.append(last)
        if end - last >= least or end == len(data) and end > last:
            ends.append(end)
            last = end
    return ends


def chunk_list(data: bytes) -> tuple[list[bytes], list[bytes]]:
    """Digests and bytes of the chunks of ``data``, in order."""
    last, parts = 0, []
    for end in cuts(data):
        parts.append(data[last:end])
        last = end
    return [hashlib.sha256(p).digest() for p in parts], parts


def stored_form(digests: list[bytes], lengths: list[int]) -> bytes:
    return MAGIC + b"".join(struct.pack(ENTRY, d, n) for d, n in zip(digests, lengths))


def read_form(form: bytes) -> list[tuple[bytes, int]]:
    if form[: len(MAGIC)] != MAGIC:
        raise ValueError("not a chunk list")
    return list(struct.iter_unpack(ENTRY, form[len(MAGIC) :]))


def rebuild(form: bytes, fetch) -> bytes:
    """The payload whose stored form is ``form``; ``fetch`` gives a chunk's
    bytes by digest.  Raises if a chunk is missing or does not match."""
    parts = []
    for digest, length in read_form(form):
        part = fetch(digest)
        if part is None or len(part) != length or hashlib.sha256(part).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} is missing or damaged")
        parts.append(part)
    return b"".join(parts)


def feature_of(payload: bytes, chunks: int) -> str:
    """Integers only, so that the string is the same everywhere: chunks, sum
    and sum of squares of the samples, and counts of their 16 high nibbles."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    value = np.arange(256)
    return f"chunks={chunks};sum={int(counts @ value)};sq={int(counts @ value**2)};hist=" + ",".join(map(str, counts.reshape(16, 16).sum(1).tolist()))


def described(form: bytes, payload: bytes) -> tuple:
    n = (len(form) - len(MAGIC)) // struct.calcsize(ENTRY)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(form), hashlib.sha256(form).hexdigest(), feature_of(payload, n)


FACTS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
FACT_TYPES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FACT_ARROW = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _digests(unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, int] = {}
            for text in batch.column(0):
                for d in chunk_list(payload_of(text.as_py(), unit)[1])[0]:
                    found[d] = found.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["digest", "n"])

    return run


def _rows(unit: int, repeated):
    """What is stored for each document: its form, and in its row the chunks
    that occur nowhere else; ``refs`` are the digests of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "sha", "form", "own", "refs")}
            for n, digests, parts, common in _parted(batch, unit, repeated):
                form = stored_form(digests, list(map(len, parts)))
                own = {d: p for d, p in zip(digests, parts) if d not in common}
                refs = [d for d in dict.fromkeys(digests) if d in common]
                out["n_bytes"].append(n)
                out["sha"].append(hashlib.sha256(form).digest())
                out["form"].append(form)
                out["own"].append([{"digest": d, "bytes": p} for d, p in own.items()])
                out["refs"].append(refs or None)
            chunks = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))
            kinds = [pa.int64(), pa.binary(), pa.binary(), chunks, pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["doc_id", *out])

    return run


def _repeated_chunks(unit: int, repeated):
    """Digest and bytes of the repeated chunks, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {d: p for _, digests, parts, common in _parted(batch, unit, repeated) for d, p in zip(digests, parts) if d in common}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "bytes"])

    return run


def _parted(batch: pa.RecordBatch, unit: int, repeated) -> Iterator[tuple]:
    """Bytes of each text, digests and bytes of its chunks, and a set that
    holds the repeated ones among them (the batch's marks if none is told)."""
    told = repeated.value if repeated is not None else None
    marks = batch.column(2) if told is None else [None] * len(batch)
    for text, marked in zip(batch.column(1), marks):
        n, payload = payload_of(text.as_py(), unit)
        yield n, *chunk_list(payload), told if told is not None else set(marked.as_py() or ())


def _facts(kept: list[str]):
    """``kept`` columns and the facts of the payload rebuilt from the form and
    the chunks (own, and fetched if there is such a column) in a stored row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = []
            stored = [batch.column(i).to_pylist() for i in range(len(kept), batch.num_columns)]
            for form, *held in zip(*stored):
                chunks = {c["digest"]: c["bytes"] for part in held for c in part or ()}
                facts.append(described(form, rebuild(form, chunks.get)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *(pa.array([f[i] for f in facts], k) for i, k in enumerate(FACT_ARROW))], names=[*kept, *FACTS])

    return run


CHUNKS = "array<struct<digest: binary, bytes: binary>>"


def store_media(docs: DataFrame, *, unit: int = 576, broadcast_rows: int = 500_000) -> dict[str, DataFrame]:
    """Store every text of ``docs`` as chunks, in tables that are written and
    read again; they alone give every payload back.

    Returns ``rows`` (a row a document: doc_id, n_bytes, sha, the digest of its
    stored form, form, own, the chunks that occur once in the corpus, and refs,
    the digests of its repeated chunks, null if it has none), ``lists`` (sha,
    form, own, refs of the distinct forms with repeated chunks) and ``chunks``
    (each repeated chunk once: digest, bytes).
    """
    spark = docs.sparkSession
    small_batches(spark)
    repeated = materialize(docs.select("text").mapInArrow(_digests(unit), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest"))
    source, told = docs.select("doc_id", "text"), None
    if repeated.count() <= broadcast_rows:
        told = spark.sparkContext.broadcast({bytes(r[0]) for r in repeated.collect()})
    else:
        source = _flagged(source, repeated, unit)
    rows = materialize(source.mapInArrow(_rows(unit, told), f"doc_id long, n_bytes long, sha binary, form binary, own {CHUNKS}, refs array<binary>"))
    chunks = materialize(source.mapInArrow(_repeated_chunks(unit, told), "digest binary, bytes binary").dropDuplicates(["digest"]))
    return {"rows": rows, "lists": rows.where("refs is not null").select("sha", "form", "own", "refs").dropDuplicates(["sha"]), "chunks": chunks}


def _flagged(source: DataFrame, repeated: DataFrame, unit: int) -> DataFrame:
    """``source`` with the repeated digests of each text, found by joins: texts
    are keyed by their digest, so that equal texts are looked up once."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests = [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                found = set(chunk_list(payload_of(text, unit)[1])[0])
                keys += [hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.binary())], names=["key", "digest"])

    key = F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256))
    pairs = source.select("text").mapInArrow(listed, "key binary, digest binary").distinct()
    marks = materialize(pairs.join(repeated, "digest").groupBy("key").agg(F.collect_list("digest").alias("marks")))
    return source.withColumn("key", key).join(marks, "key", "left").select("doc_id", "text", "marks")


def media_facts(docs: DataFrame, *, unit: int = 576, broadcast_rows: int = 500_000) -> DataFrame:
    """``doc_id, n_bytes`` and the facts of what is read back, for each row."""
    stored = store_media(docs, unit=unit, broadcast_rows=broadcast_rows)
    lists, rows = stored["lists"], stored["rows"]
    fetched = lists.select("sha", F.explode("refs").alias("digest")).join(stored["chunks"], "digest").groupBy("sha").agg(F.collect_list(F.struct("digest", "bytes")).alias("fetched"))
    facts = materialize(lists.select("sha", "form", "own").join(fetched, "sha").select("sha", "form", "own", "fetched").mapInArrow(_facts(["sha"]), f"sha binary, {FACT_TYPES}"))
    alone = rows.where("refs is null").select("doc_id", "n_bytes", "form", "own").mapInArrow(_facts(["doc_id", "n_bytes"]), f"doc_id long, n_bytes long, {FACT_TYPES}")
    return alone.union(rows.where("refs is not null").select("doc_id", "n_bytes", "sha").join(facts, "sha").select("doc_id", "n_bytes", *FACTS))
