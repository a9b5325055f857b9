"""What the two removers of repeated passages share: finding the texts that may hold any.

A window is a run of a given length; it is repeated if the same run also starts
anywhere else. Every window has an anchor, a place in it that depends on the window's
content alone, so that equal windows have equal anchors at equal places. An anchor's
name is a hash of what stands there. Only windows whose anchor's name stands in two
places or more can be repeated, and only texts with such anchors are looked at again.

Texts that are equal throughout are one class. Of a class with several documents all
windows are repeated, and one document of it stands for what it has in common with
other classes. So no group of copies is ever compared with itself, however large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ragged, text_chunks

#: Of a batch of texts: sizes, anchors of each, names of all anchors in order, and what is kept of each if all is.
Describe = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]

_PRINT = "doc_id bigint, tie bigint, n bigint, high bigint, low bigint, names array<bigint>, sha256 string"


def digests(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The first 128 bits of each part's SHA-256 as two numbers, and all of it in hex."""
    full = [hashlib.sha256(p).digest() for p in parts]
    numbers = np.frombuffer(b"".join(d[:16] for d in full), np.int64).reshape(-1, 2)
    return numbers[:, 0].copy(), numbers[:, 1].copy(), [d.hex() for d in full]


def describe_documents(docs: DataFrame, describe: Describe, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The documents as doc_id, tie, text; and a row for each with its size, class and anchors, written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            n, counts, names, kept = describe(batch["text"])
            high, low, hexed = digests(kept)
            columns = [
                batch["doc_id"],
                batch["tie"],
                pa.array(n.astype(np.int64)),
                pa.array(high),
                pa.array(low),
                ragged(names.view(np.int64), counts),
                pa.array(hexed),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "n", "high", "low", "names", "sha256"])

    named = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text")
    )
    return named, materialise(named.mapInArrow(work, _PRINT), "anchors")


def candidates(named: DataFrame, prints: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Classes (high, low, cls, copies), and the texts that may hold repeated windows.

    These are a row for each class: cls, copies, text and ``shared``, the numbers of
    its anchors whose names stand elsewhere. Both are written.
    """
    classes = prints.where(F.col("n") >= length).groupBy("high", "low").agg(
        F.min(F.struct("doc_id", "tie")).alias("row"), F.count("*").alias("copies"), F.first("names").alias("names")
    )
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    anchors = classes.select("cls", F.posexplode("names").alias("anchor", "name"))
    twice = anchors.groupBy("name").agg(F.count("*").alias("times")).where("times > 1").select("name")
    shared = anchors.join(materialise(twice, "shared"), "name").groupBy("cls").agg(F.collect_list("anchor").alias("shared"))
    shared = shared.join(classes.select("cls", "row", "copies"), "cls")
    # Rows that are equal in id and text stand for one.
    times = prints.groupBy("doc_id", "tie").agg(F.count("*").alias("times")).where("times > 1")
    wanted = shared.select("cls", "copies", "shared", "row.doc_id", "row.tie")
    joined = named.join(wanted, named["doc_id"].eqNullSafe(wanted["doc_id"]) & (named["tie"] == wanted["tie"]))
    joined = joined.select("cls", "copies", "shared", "text", named["doc_id"], named["tie"])
    repeated = joined["doc_id"].eqNullSafe(times["doc_id"]) & (joined["tie"] == times["tie"])
    marked = joined.join(times, repeated, "left").select("cls", "copies", "shared", "text", "times")
    once = marked.where("times IS NULL").drop("times")
    several = marked.where("times > 1").groupBy("cls").agg(*[F.first(c).alias(c) for c in ("copies", "shared", "text")])
    texts = materialise(once.unionByName(several), "texts")
    return classes.select("high", "low", "cls", "copies"), texts


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places windows from ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def results(prints: DataFrame, classes: DataFrame, removed: DataFrame, length: int, spans: bool) -> DataFrame:
    """A row for each document from what was removed of its class (cls, n_removed, n_spans, sha256)."""
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    mine = classes.join(removed.withColumnRenamed("sha256", "left_sha256"), "cls", "left").drop("cls")
    whole = (F.col("copies") > 1) & (F.col("n") >= length)
    joined = prints.drop("names").join(mine, ["high", "low"], "left")
    columns = [
        "doc_id",
        "n",
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, nothing).otherwise(F.coalesce("left_sha256", "sha256")).alias("kept_sha256"),
    ]
    if spans:
        columns.insert(3, F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"))
    return joined.select(*columns)
