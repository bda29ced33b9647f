"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are far shorter than documents, so their resemblance to a document is tiny though all of
an item may be in it. Items are partitioned by their number q of distinct shingles, and each partition
has a bottom-k MinHash sketch of its own size: an item of which a share t must be found can miss at most
q - ceil(t q) shingles, so any document that holds enough of it has one of its q - ceil(t q) + 1 least
hashes. A join on those hashes therefore finds every such document, and the candidates are verified by
counting the item's shingles in the document as text. Expressions of Spark alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, need, small_or_shuffled, words

SHINGLE, SHARE = 5, 0.8


def _hashes(w: Column, width: int) -> Column:
    """A hash for each run of ``width`` words of the array ``w``; none if it is shorter."""
    one = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), one)).otherwise(F.array().cast("array<long>"))


def _shingles(w: Column, width: Column) -> Column:
    """The distinct runs of ``width`` words of the array ``w``, joined by spaces."""
    one = lambda i: F.array_join(F.slice(w, i, width), " ")
    return F.when(F.size(w) >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), one))).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """``item_id``, ``width``, ``shingles``, ``need`` and ``least`` (the hashes of the sketch) of every item.

    An item with fewer words than a shingle has its whole sequence as the one shingle, of that ``width``;
    an item without words, or null, can't be found and is left out.
    """
    w = items.select("item_id", words(F.lower("text")).alias("w")).where(F.size("w") > 0).withColumn("width", F.least(F.lit(shingle), F.size("w")))
    q = w.withColumn("shingles", _shingles(F.col("w"), F.col("width"))).withColumn("need", F.ceil(F.round(F.size("shingles") * share, 9)).cast("int"))
    hashes = F.lit(None).cast("array<long>")
    for width in range(1, shingle + 1):
        hashes = F.when(F.col("width") == width, _hashes(F.col("w"), width)).otherwise(hashes)
    least = F.slice(F.array_sort(F.array_distinct(hashes)), 1, F.size("shingles") - F.col("need") + 1)
    return q.withColumn("least", least).select("item_id", "width", "shingles", "need", "least")


def leaks(docs: DataFrame, items: DataFrame, *args: object, **how: object) -> DataFrame:
    """:func:`found` without the hash that tells apart documents that share an id."""
    return found(docs, items, *args, **how).drop("text_hash")


def found(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", shingle: int = SHINGLE, share: float = SHARE,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_shingles``, ``n_found``, ``containment``, ``text_hash`` where at least ``share`` is found.

    ``text_hash`` (XXH64 of the text) comes with each row. Words are runs of other characters than ASCII white space, in lower case; whole texts are searched.
    Null and blank texts hold nothing. Rows of documents that repeat id and text give one row for each
    item. Rows of items that repeat an id are items of their own. A null id is returned as it is.
    """
    rows = need(docs, doc_id=id_col, text=text_col)
    sketched = checkpointed(sketches(need(items, item_id=item_col, text=item_text_col), shingle, share).withColumn("item", F.monotonically_increasing_id()))
    widths = [r.width for r in sketched.select("width").distinct().collect()]  # at most ``shingle`` numbers
    keys = sketched.select("item", "width", "need", F.explode("least").alias("h"))
    # two longs and two numbers a row
    keys = small_or_shuffled(checkpointed(keys))
    w = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.lower("text")).alias("w"))
    searched = None
    for width in sorted(widths, reverse=True):
        # a document below the size that an item needs is no candidate of it
        at = w.select("doc_id", "text_hash", (F.size("w") - width + 1).alias("size"), F.explode(_hashes(F.col("w"), width)).alias("h"))
        hit = at.join(keys.where(F.col("width") == width), "h").where("size >= need").select("doc_id", "text_hash", "item")
        searched = hit if searched is None else searched.unionByName(hit)
    if searched is None:
        searched = w.select("doc_id", "text_hash", F.lit(0).cast("long").alias("item")).where(F.lit(False))
    pairs = checkpointed(searched.distinct())
    # documents are read again for the candidates alone; three numbers a row
    left = small_or_shuffled(pairs.select(F.col("doc_id").alias("id"), "text_hash", "item"))
    # words are a column of their own, else each shingle would split the text again
    texts = rows.select("doc_id", "text", F.xxhash64("text").alias("h")).join(
        left, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("text_hash"))
    ).select("doc_id", "text_hash", "item", words(F.lower("text")).alias("w"))
    checked = texts.join(sketched.drop("least"), "item").select(
        "doc_id", "text_hash", "item", "item_id", "need", F.size("shingles").alias("n_shingles"),
        F.size(F.array_intersect("shingles", _shingles(F.col("w"), F.col("width")))).alias("n_found"),
    ).distinct()
    return checked.where("n_found >= need").select(
        "doc_id", "item_id", "n_shingles", "n_found", F.round(F.col("n_found") / F.col("n_shingles"), 6).alias("containment"), "text_hash"
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The rows of ``docs``, all columns, in whose own text no item is found.

    A row is told by id and text, so that others with its id, or without an id, stay. Null texts stay.
    """
    bad = found(docs, items, id_col, text_col, **how).select(F.col("doc_id").alias("__leaked"), F.col("text_hash").alias("__hash")).distinct()
    here = F.col(f"`{id_col}`").eqNullSafe(F.col("__leaked")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__hash"))
    return docs.join(small_or_shuffled(checkpointed(bad)), here, "left_anti")


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (
  SELECT row_number() OVER () AS item, item_id, w, least(5, len(w)) AS width
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0),
si AS (
  SELECT DISTINCT item, item_id, width, array_to_string(w[i : i + width - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM iw)),
q AS (SELECT item, count(*) AS n FROM si GROUP BY item),
sd AS (
  SELECT DISTINCT doc_id, text, width, array_to_string(w[i : i + width - 1], ' ') AS s
  FROM (SELECT dw.*, width, unnest(range(1, len(w) - width + 2)) AS i FROM dw, (SELECT DISTINCT width FROM iw)))
SELECT doc_id, item_id, q.n::INT AS n_shingles, count(*)::INT AS n_found, round(count(*) / q.n, 6) AS containment
FROM sd JOIN si USING (width, s) JOIN q USING (item)
GROUP BY doc_id, text, item, item_id, q.n HAVING count(*) >= ceil(round(q.n * 0.8, 9))
"""
