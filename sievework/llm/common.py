"""What several operators share: word rules, shared storage, size-checked joins, components."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import shared_dir

#: A side of a join is broadcast up to this many rows; each use states the width of a row.
BROADCAST_ROWS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it was."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """Maximal runs of other characters than ASCII white space, as an array; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANK), lambda w: w != "")


def split_words(text: str | None) -> list[bytes]:
    """:func:`words` of lower-cased text, as UTF-8; bytes.lower and bytes.split know ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that losing an executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``limit`` rows.

    Beyond that it is returned as it is: the join shuffles, and adaptive execution splits hot keys.
    ``df`` should be cheap to count (checkpointed, or read from a table).
    """
    return F.broadcast(df) if len(df.limit(limit + 1).select(F.lit(1)).take(limit + 1)) <= limit else df


def by_batch(df: DataFrame, make: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Each Arrow batch of ``df`` through ``make``; nothing is kept from one batch to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from make(batch)

    return df.mapInArrow(run, schema)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 14) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal ``keys``, from batches sorted by them.

    A table has about ``least`` rows, or as many as its longest run; the open run is held back.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        new = starts_of(table, keys)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut).combine_chunks()
        held, rows = rest.to_batches(), rest.num_rows
        least = max(least, 2 * rows) if not cut else least
    if held:
        yield pa.Table.from_batches(held)


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row differs in ``keys`` from the one before; True for the first."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = table[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links ``a``-``b``."""
    root = np.arange(n)
    while a.size:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            nxt = root[root]
            if np.array_equal(nxt, root):
                break
            root = nxt
        if np.array_equal(before, root):
            break
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


#: Links of whole numbers up to this many are joined in one task, which takes some 100 bytes for each.
LOCAL_LINKS = 1_000_000


def _joined_in_task(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` of links that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            rows = pa.Table.from_batches(held)
            nodes, at = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
            root = nodes[local_roots(nodes.size, at[: rows.num_rows], at[rows.num_rows :])]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["node", "component"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL_LINKS) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node that has a link to another.

    Rounds of contraction: each node names its smallest neighbour or itself, names are followed up to
    nodes that name themselves (a path of n names in log2(n) joins), links move there, and go on between
    different ones. The neighbours of a node that names itself don't, so a round keeps at most half of the
    linked nodes; nothing is collected. All joins have one side that is unique by key, so a hub's links can
    be split over tasks; minima are combined before shuffles. Once there are no more than ``local`` links between
    longs, a task joins them: a round takes the driver some twenty jobs, whose plans and threads it keeps for a while.
    Null nodes have no links. An empty input gives an empty result.
    """
    edges = checkpointed(
        links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    )
    found = None
    while n := edges.count():
        if n <= local and {k for _, k in edges.dtypes} == {"bigint"}:
            found = _renamed(found, _joined_in_task(edges).withColumnRenamed("component", "name"))
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        name = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("name")))
        moved = True
        while moved:
            up = name.select(F.col("node").alias("name"), F.col("name").alias("above"))
            jumped = checkpointed(name.join(up, "name").select("node", "name", "above"))
            moved = not jumped.where("above <> name").isEmpty()
            name = jumped.select("node", F.col("above").alias("name"))
        found = _renamed(found, name)
        left = name.select(F.col("node").alias("a"), F.col("name").alias("x"))
        right = name.select(F.col("node").alias("b"), F.col("name").alias("y"))
        edges = checkpointed(
            edges.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found


def _renamed(found: DataFrame | None, name: DataFrame) -> DataFrame:
    """``found`` with the names of its components, if there are new ones."""
    if found is None:
        return checkpointed(name.select("node", F.col("name").alias("component")))
    up = name.select(F.col("node").alias("component"), "name")
    return checkpointed(found.join(up, "component", "left").select("node", F.coalesce("name", "component").alias("component")))


#: Rows that go to a Python worker at a time, where the session says no other number: texts can be long.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def need(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of ``df``, under the operator's own names.

    Other columns of ``df`` can have any name, so they don't clash with those an operator makes. Where the
    session has Spark's default of 10,000 rows for Arrow batches, it gets BATCH_ROWS.
    """
    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, which only Spark may be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The most labelled documents that a classifier is fitted on, and the most characters they have.
TRAIN_DOCS, TRAIN_CHARS = 8_000, 24_000_000


def _sample(docs: DataFrame, labels: DataFrame, trusted: Column, label_col: str, most_docs: int) -> DataFrame:
    """``label``, ``text`` and ``h``, the hash that orders them, of the documents with the least hashes."""
    usable = labels.where(trusted & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).alias("label"))
    # rows whose hash is far above the sample's are left out before the sort, so that no task gets each one's least
    share = min(1.0, 2 * most_docs / max(1, usable.count()))
    near = usable.where(F.xxhash64("doc_id") <= F.lit(int(share * ((1 << 64) - 1)) - (1 << 63) if share < 1 else (1 << 63) - 1))
    chosen = near.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most_docs)
    # at most most_docs rows of two numbers
    got = need(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id")
    return got.select("label", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("h"))


def _bounded(rows: Iterable[tuple[int, str]], most_chars: int) -> tuple[list[str], np.ndarray]:
    """The texts that ``most_chars`` characters have room for, and their labels; the first text where none fits."""
    texts, ys, chars, over = [], [], 0, None
    for label, text in rows:
        if chars + len(text) > most_chars:
            over = over or (label, text)
            continue
        chars += len(text)
        texts.append(text)
        ys.append(int(label))
    if over and not texts:
        texts, ys = [over[1]], [int(over[0])]
    return texts, np.array(ys, np.int64)


def training_rows(
    docs: DataFrame, labels: DataFrame, trusted: Column, label_col: str, most_docs: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS
) -> tuple[list[str], np.ndarray]:
    """A bounded sample of labelled texts, by the hash of their ids, and their labels.

    At most ``most_docs`` documents and ``most_chars`` characters: a text that exceeds what is left of them is
    passed over, and later ones are still taken; the first one is taken where none fits. ``trusted`` is over
    ``doc_id`` and says which labels may be learned from; null labels and ids are left out.
    """
    rows = _sample(docs, labels, trusted, label_col, most_docs).orderBy("h", "text").toLocalIterator()
    return _bounded(((r.label, r.text) for r in rows), most_chars)


def trained_in_task(
    docs: DataFrame, labels: DataFrame, trusted: Column, label_col: str, train: Callable[[list[str], np.ndarray], Any],
    most_docs: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS,
) -> Any:
    """What ``train`` makes of :func:`training_rows`, made in a task: the driver gets neither texts nor what training needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((y, t.as_py()) for b in batches for y, t in zip(b["label"].to_pylist(), b["text"], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(*_bounded(rows, most_chars)))], pa.binary())], names=["model"])

    one = _sample(docs, labels, trusted, label_col, most_docs).repartition(1).sortWithinPartitions("h", "text").select("label", "text")
    made = one.mapInArrow(run, "model binary").collect()
    # a plan that is known to be empty has no task
    return pickle.loads(bytes(made[0].model)) if made else train([], np.zeros(0, np.int64))
