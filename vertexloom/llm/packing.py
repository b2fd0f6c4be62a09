"""Packing documents into sequences by best-fit decreasing.

Documents are tokenized, end with an end id, and are cut into full windows;
what is left of each is a piece.  Pieces are packed longest first, each into
the open window with the least room that fits it: a segment tree over room
sizes tells which room sizes are open.  Full windows are sequences already.

Pieces are packed in groups, which any task can do alone: by a hash of the
piece's number in the written table, so that equal rows are spread, or by a
column the caller gives (such as a stretch of a mixed order) and that hash.
A group holds about ``group_rows`` pieces whatever the size of the corpus.

Defined results: a null text is an empty one, which has just the end id.
Repeated ids or rows are packed row by row.  Only ``doc_id`` and ``text`` (and
the group column) are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_batches


class OpenWindows:
    """Rooms of open windows: a segment tree over 0..size-1 whose leaves say
    whether a window with that room is open."""

    def __init__(self, size: int):
        self.leaves = 1 << (size - 1).bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        at = room + self.leaves
        while at and not self.tree[at]:
            self.tree[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and window of the tightest open window with room >= need."""
        at, tree = need + self.leaves, self.tree
        while not tree[at]:  # up, until what hangs off to the right is open
            if at == 1:
                return None
            if not at & 1 and tree[at + 1]:
                at += 1
            else:
                at >>= 1
                if tree[at]:  # open to the left of need only
                    while at != 1 and (at & 1 or not tree[at + 1]):
                        at >>= 1
                    if at == 1:
                        return None
                    at += 1
        while at < self.leaves:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        window = self.windows[room].pop()
        if not self.windows[room]:
            tree[at] = 0
            while at > 1 and not tree[at ^ 1]:
                at >>= 1
                tree[at] = 0
        return room, window


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; pieces are at most ``size``."""
    window, offset = [0] * len(lengths), [0] * len(lengths)
    open_, made = OpenWindows(size), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        got = open_.take(n) if n < size else None
        if got is None:
            got, made = (size, made), made + 1
        room, window[i] = got
        offset[i] = size - room
        if room > n:
            open_.add(room - n, window[i])
    return window, offset


def _pieces(tokenizer: str | None, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, size):
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take).cast(pa.int64()), batch.column(2).take(take), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "stretch", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def encoder(tokenizer: str | None):
    """A function from text to its ids as little-endian unsigned 32-bit bytes.

    tokenizer: path of the vocabulary's tokenizers file (null: the public byte
    BPE).  Where the same vocabulary lies beside it as ranks, ids come from
    those, several times faster; a text with a special token's string, and any
    other vocabulary, goes through tokenizers itself.
    """
    import base64
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    special = [t.content for t in model.get_added_tokens_decoder().values()]
    slow = lambda text: np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: slow(text) if any(s in text for s in special) else np.array(fast.encode_ordinary(text), "<u4").tobytes()


def _pack(size: int):
    def run(key, group):
        # a fixed order first, so that a repeated task gives the same sequences
        group = group.sort_by([(c, "ascending") for c in ("length", "doc_id", "start", "ids_crc32", "row")])
        window, offset = best_fit_decreasing(group.column("length").to_pylist(), size)
        base = key[0].as_py() << 32
        out = group.drop_columns(["grp", "stretch", "row"])
        return out.append_column("sequence_id", pa.array([base + w for w in window], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "group": pa.Table, "return": pa.Table}
    return run


def pack_documents(docs: DataFrame, *, size: int = 2048, end_id: int = 1, tokenizer: str | None = None, group_rows: int = 50_000, stretch: str | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of
    every piece of every row of ``docs``.

    stretch: a column; only documents with one value of it share sequences,
    and sequence ids follow the order of its values (null first).
    """
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text", (F.col(stretch) if stretch else F.lit(None).cast("string")).alias("stretch"))
    kind = dict(source.dtypes)["stretch"]
    pieces = source.mapInArrow(_pieces(tokenizer, size, end_id), f"doc_id long, stretch {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()))
    if stretch:
        # groups are numbered in the order of the stretches, of which the driver sees one row each
        sizes, numbered, first = pieces.groupBy("stretch").agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("parts")).orderBy("stretch").collect(), [], 0
        for value, parts in sizes:
            numbered.append((value, parts, first))
            first += parts
        groups = docs.sparkSession.createDataFrame(numbered, f"s {kind}, parts long, first long")
        pieces = pieces.join(groups, F.col("stretch").eqNullSafe(F.col("s"))).drop("s")
        group = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))
        pieces = pieces.withColumn("grp", group).drop("parts", "first")
    else:
        parts = max(1, -(-pieces.count() // group_rows))
        pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("long"))
    return pieces.groupBy("grp").applyInArrow(_pack(size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
