"""A corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

Each stage takes all that the stage before kept.  All but the last return the
columns of their input; the third rewrites ``text`` and ``n_chars``.

Defined results: a null text counts as an empty one; the classifier may reject
both, no class holds them, they have no secrets (a null text stays null and
keeps its n_chars), and they pack as the end id alone.  Rows with null or
repeated ids are rows like others; of rows equal in doc_id and text one stays
after the second stage.  Extra columns pass through, whatever their names.  An
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import minhash, mixing, packing, quality, secret_scan
from vertexloom.llm.shared import fresh, materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    score = quality.quality_score(docs, table(spark, sf_dir, "labels"))
    return docs.where(score("text") >= 0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.keep_one(docs, minhash.near_duplicates(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("text", secret_scan.redact(F.col("text"))).withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files, and rows within a file,
    follow one another as the sources' blocks are scheduled."""
    names = tuple(fresh(docs, "_block", "_slot", "_position"))
    placed = mixing.mix_sources(docs, weights=mixing.TARGETS, names=names)
    return placed.repartitionByRange(names[2]).sortWithinPartitions(names[2]).select(docs.columns)


#: Slots of the mix whose documents are packed together.
STRETCH_SLOTS = 16


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces; sequence ids follow the mix.  A sequence holds documents
    of one stretch of the mixed stream, a fixed number of slots however many
    files there are, so that every stretch of sequences has the mix's weights.

    A document's place in the stream is the rows of the files before its own,
    plus its row in the file; the driver sees one row a file.  Rows that do not
    come from files alone are in the order of their partitions."""
    stretch, name, before = fresh(docs, "_stretch", "_file", "_before")
    placed, part, row = _rows_in_order(docs, stretch)
    files, starts, at = placed.groupBy(part.alias(name)).count().collect(), [], 0
    for file, n in sorted(files):
        starts.append((file, at))
        at += n
    ahead = spark.createDataFrame(starts, f"{name} string, {before} long")
    placed = placed.select(*docs.columns, part.alias(name), row.alias(stretch)).join(F.broadcast(ahead), name)
    place = F.floor((F.col(before) + F.col(stretch)) / (STRETCH_SLOTS * mixing.BLOCK)).cast("long")
    return packing.pack_documents(placed.withColumn(stretch, place), stretch=stretch)


def _rows_in_order(docs: DataFrame, number: str) -> tuple[DataFrame, Column, Column]:
    """``docs``, the part that each row is in (parts sort as strings), and its
    number there."""
    try:
        part, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        docs.select(part, row)
        return docs, part, row
    except AnalysisException:
        # the number is fixed once it is written: 33 bits of row below the partition
        docs = materialize(docs.withColumn(number, F.monotonically_increasing_id()))
        return docs, F.lpad(F.shiftright(number, 33).cast("string"), 10, "0"), F.col(number).bitwiseAND(F.lit((1 << 33) - 1))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = materialize(docs)
    return docs


#: Trained scores, signatures and schedules are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
