"""Embedding near-dedup: sign hashing, exact cosine, connected components.

Random hyperplanes give each vector one code per table; vectors that agree in
any table are compared by cosine in double precision inside numpy blocks, and
what leaves a block is one row per linked vector (its number of links, its
smallest linked vector), never the pairs.  Equal vectors are one node with a
multiplicity.  Buckets above ``block`` rows are cut into blocks and each pair
of blocks is one group, so no group grows with the data and no pair is lost.

Defined results: a null, empty or zero vector, or one with a null or
non-finite component, links with nothing; so does a row with a null vec_id
(its component_id is null).  Vectors of different lengths never link.  Rows
that share a vec_id and have other vectors are other nodes, each with the links
and component of its own vector.  Only ``vec_id`` and ``embedding`` are read;
other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, hot_join, materialize, small_batches

#: Big buckets that are told to the tasks by broadcast; more go by a join.
BROADCAST_ROWS = 50_000


def tables_for(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits a code and number of tables: about 64 rows a bucket, and a pair at
    the threshold missed by all tables with probability ``miss`` at most."""
    bits = min(28, max(6, round(math.log2(max(rows, 1) / 64))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def _signer(bits: int, tables: int, seed: int):
    def codes(dim: int, x: np.ndarray) -> np.ndarray:
        planes = np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, bits * tables))
        set_ = (x @ planes > 0).reshape(len(x), tables, bits)
        return (set_ * (1 << np.arange(bits))).sum(2).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values = column.values.to_numpy(zero_copy_only=False)
            offsets = column.offsets.to_numpy()
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            content, vectors, dims, signs = ([None] * len(batch) for _ in range(4))
            rows: dict[int, list[int]] = {}
            for i in range(len(batch)):
                v = values[offsets[i] : offsets[i + 1]]
                if not nulls[i] and len(v) and np.isfinite(v).all() and v.any():
                    rows.setdefault(len(v), []).append(i)
                    vectors[i] = v.tobytes()
                    content[i] = hashlib.blake2b(vectors[i], digest_size=16).digest()
                    dims[i] = len(v)
            for dim, at in rows.items():
                x = _unit(np.stack([values[offsets[i] : offsets[i + 1]] for i in at]))
                for i, code in zip(at, codes(dim, x)):
                    signs[i] = code
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(content, pa.binary()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary()), pa.array(signs, pa.list_(pa.int32()))], names=["vec_id", "content", "dim", "vec", "codes"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _linker(threshold: float, kind: str):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_out, counts_out, least_out = [], [], []
            for t, i, j, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                items = rows.values
                ids = items.field("node").to_numpy()
                side = items.field("blk").to_numpy()
                weight = items.field("n").to_numpy()
                x = _unit(np.frombuffer(b"".join(items.field("vec").to_pylist()), kind).reshape(len(ids), -1))
                codes = np.array(items.field("codes").to_pylist(), np.int32)
                left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
                sim = x[left] @ x[right].T
                close = sim >= threshold - 1e-9
                if i == j:
                    close = np.triu(close, 1)
                a, b = np.nonzero(close)
                doubtful = np.flatnonzero(sim[a, b] < threshold + 1e-9)
                keep = np.ones(len(a), bool)
                for e in doubtful:
                    keep[e] = math.fsum(x[left[a[e]]] * x[right[b[e]]]) >= threshold
                a, b = left[a[keep]], right[b[keep]]
                if not len(a):
                    continue
                # a pair counts in the first table in which its codes agree
                seen = np.zeros(len(a), bool)
                for k in range(t):
                    seen |= codes[a, k] == codes[b, k]
                count = np.zeros(len(ids), np.int64)
                np.add.at(count, a[~seen], weight[b[~seen]])
                np.add.at(count, b[~seen], weight[a[~seen]])
                label = ids.copy()
                while True:
                    before = label.copy()
                    both = np.minimum(label[a], label[b])
                    np.minimum.at(label, a, both)
                    np.minimum.at(label, b, both)
                    if (label == before).all():
                        break
                linked = np.unique(np.concatenate([a, b]))
                ids_out.append(ids[linked])
                counts_out.append(count[linked])
                least_out.append(label[linked])
            cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(x), pa.int64()) for x in (ids_out, counts_out, least_out)], names=["node", "links", "least"])

    return blocks


def near_vectors(vectors: DataFrame, *, threshold: float = 0.9, miss: float = 1e-3, block: int = 1024, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``.

    threshold: least cosine of a link.  miss: probability that a pair at just
    that cosine meets in no table (pairs above it are missed less often).
    block: most rows of one side of a comparison.
    """
    double = dict(vectors.dtypes)["embedding"] != "array<float>"
    source = vectors.select("vec_id", F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    small_batches(vectors.sparkSession)
    bits, tables = tables_for(vectors.count(), threshold, miss)
    signed = materialize(source.mapInArrow(_signer(bits, tables, seed), "vec_id long, content binary, dim int, vec binary, codes array<int>"))
    nodes = signed.where("content is not null and vec_id is not null").groupBy("content").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.first("codes").alias("codes"))
    # a node's number is fixed once it is written
    reps = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    big = materialize(reps.select("dim", F.posexplode("codes").alias("t", "code")).groupBy("dim", "t", "code").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block))
    small_enough = big.count() <= BROADCAST_ROWS
    rows = reps.select("node", "n", "dim", "vec", "codes", F.posexplode("codes").alias("t", "code"))
    rows = rows.join(F.broadcast(big) if small_enough else big, ["dim", "t", "code"], "left")
    parts = F.coalesce(F.ceil(F.col("size") / block), F.lit(1))
    rows = rows.withColumn("parts", parts).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    groups = (
        rows.groupBy("dim", "t", "code", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
        .agg(F.collect_list(F.struct("node", "n", "blk", "vec", "codes")).alias("rows"))
        .where("size(rows) > 1")
    )
    linked = materialize(groups.select("t", "i", "j", "rows").mapInArrow(_linker(threshold, "<f8" if double else "<f4"), "node long, links long, least long").groupBy("node", "least").agg(F.sum("links").alias("links")))
    component = connected_components(linked.select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    named = materialize(component.join(reps.select("node", "rep"), "node"))
    first = materialize(named.groupBy("component").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("size")))
    chosen = hot_join(named.select("component", "node"), first, "component", "size", max(1000, named.count() // 2000), "node").select("node", "first")
    nodes = reps.select("content", "node", "rep", "n").join(links, "node", "left").join(chosen, "node", "left")
    found = signed.select("vec_id", "content").join(nodes, "content", "left")
    named = F.col("vec_id").isNotNull()
    return found.select(
        "vec_id",
        F.when(named & F.col("rep").isNotNull(), F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(named, F.coalesce("first", "rep", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
