"""Packing into optimal length buckets.

Texts are cut into pieces of at most ``most`` words, so their lengths have a histogram of at most
``most`` rows. Dynamic programming over it chooses the upper ends of ``buckets`` buckets such that
padding every piece to its bucket's end adds least. In each bucket, pieces in order of length and id
(dealt to parts by its hash) fill batches whose padded size keeps within a budget of tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, need, words
from sievework.operators.statistics import numbered

MOST_WORDS, BUCKETS, BUDGET = 1024, 8, 16_384
#: Pieces of one length are numbered in this many parts, so that no length is a single task's.
PARTS = 64


def best_ends(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding; the smaller start wins a tie.

    ``histogram`` has (length, count) rows; an empty one has no buckets.
    """
    if not histogram:
        return []
    length, count = np.array(sorted(histogram), np.int64).T
    n = length.size
    before, tokens = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * length)]
    # cost[i, j]: padding of lengths i..j-1 to length j-1
    i, j = np.arange(n)[:, None], np.arange(1, n + 1)[None, :]
    far = np.int64(1) << 62
    cost = np.where(i < j, length[j - 1] * (before[j] - before[i]) - (tokens[j] - tokens[i]), far)
    best = np.r_[0, np.full(n, far)]
    froms = []
    for _ in range(min(buckets, n)):
        total = np.where((best[:n, None] < far) & (cost < far), best[:n, None] + cost, far)
        start = total.argmin(0)
        best = np.r_[far, total[start, np.arange(n)]]
        froms.append(np.r_[0, start])
    # exactly min(buckets, n) buckets: another one never adds padding
    ends, at = [], n
    for start in reversed(froms):
        ends.append(int(length[at - 1]))
        at = int(start[at])
    return ends[::-1]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """``doc_id``, ``piece``, ``start`` (in words), ``n_words``: whole texts, cut after ``most`` words.

    A text without words, and a null one, has no pieces.
    """
    n = need(docs, doc_id=id_col, text=text_col).select("doc_id", F.size(words(F.col("text"))).alias("n"))
    cut = n.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("int"))).alias("piece"))
    return cut.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).alias("n_words"))


def _part(doc_id):
    return (F.conv(F.left(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)), 16, 10).cast("int") % PARTS).cast("int")


def batches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_WORDS, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """Every piece with its ``bucket`` (from 0), ``bucket_end``, ``batch`` in the bucket and ``padding``.

    Batch k of a bucket has the pieces numbered from k * floor(budget / end), in order of length, part,
    id and piece. Pieces are numbered without bringing a bucket together: those of one length are dealt
    to PARTS parts by the MD5 of their id, each of which is numbered over ranges of its rows, and a table of at most
    ``most`` * PARTS counts says where each part starts. Null ids are numbered like others. Empty input gives an empty result; rows that
    repeat an id are numbered one after the other.
    """
    if budget < most:
        raise ValueError("the budget must hold a longest piece")
    cut = checkpointed(pieces(docs, id_col, text_col, most).withColumn("part", _part(F.col("doc_id"))))
    counts = cut.groupBy("n_words", "part").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram: dict[int, int] = {}
    for r in counts:
        histogram[r.n_words] = histogram.get(r.n_words, 0) + r.n
    ends = best_ends(sorted(histogram.items()), buckets)
    rows, before, bucket = [], 0, 0
    by_key = {(r.n_words, r.part): r.n for r in counts}
    for length, part in sorted(by_key):
        if length > ends[bucket]:
            bucket, before = bucket + int(np.searchsorted(ends[bucket:], length)), 0
        rows.append((length, part, bucket, ends[bucket], before))
        before += by_key[length, part]
    # at most most * PARTS rows of five numbers
    starts = docs.sparkSession.createDataFrame(rows, "n_words int, part int, bucket int, bucket_end int, before long")
    # a length's part can be of any size: it is numbered over ranges of its rows
    placed = numbered(cut, ["doc_id", "piece"], "place", ["n_words", "part"]).join(F.broadcast(starts), ["n_words", "part"])
    return placed.select(
        "doc_id", "piece", "start", "n_words", "bucket", "bucket_end",
        F.floor((F.col("before") + F.col("place")) / F.floor(F.lit(budget) / F.col("bucket_end"))).alias("batch"),
        (F.col("bucket_end") - F.col("n_words")).alias("padding"),
    )


def oracle_sql(most: int = MOST_WORDS, buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """DuckDB SQL for :func:`batches` over the table of documents."""
    levels = "".join(f"""
d{k} AS (
  SELECT {k} AS k, y.j, min({{'pad': x.pad + y.len * (y.bc - x.bc) - (y.bt - x.bt), 'i': x.j}}) AS best
  FROM (SELECT p.j, p.bc, p.bt, {'0 AS pad FROM pre p WHERE p.j = 0' if k == 1 else f'd.best.pad AS pad FROM d{k - 1} d JOIN pre p USING (j)'}) x
  JOIN pre y ON x.j < y.j GROUP BY y.j),""" for k in range(1, buckets + 1))
    union = " UNION ALL ".join(f"SELECT k, j, best.i AS i FROM d{k}" for k in range(1, buckets + 1))
    return f"""
WITH RECURSIVE n AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
pieces AS (
  SELECT doc_id, p AS piece, p * {most} AS start, least({most}, n - p * {most}) AS n_words,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 4))::INT % {PARTS} AS part
  FROM (SELECT doc_id, n, unnest(range(0, (n + {most - 1}) // {most})) AS p FROM n)),
h AS (SELECT n_words AS len, count(*) AS c, row_number() OVER (ORDER BY n_words) AS j FROM pieces GROUP BY n_words),
pre AS (
  SELECT j, len, sum(c) OVER (ORDER BY j) AS bc, sum(c * len) OVER (ORDER BY j) AS bt FROM h
  UNION ALL SELECT 0, 0, 0, 0),{levels}
alld AS ({union}),
path AS (
  SELECT least({buckets}, (SELECT max(j) FROM pre)) AS k, (SELECT max(j) FROM pre) AS j
  UNION ALL
  SELECT p.k - 1, d.i FROM path p JOIN alld d ON d.k = p.k AND d.j = p.j WHERE p.k > 1),
ends AS (SELECT p.k - 1 AS bucket, pre.len AS bucket_end, lag(pre.len, 1, 0) OVER (ORDER BY p.k) AS below FROM path p JOIN pre USING (j) WHERE pre.j > 0),
placed AS (
  SELECT p.*, bucket, bucket_end,
         row_number() OVER (PARTITION BY bucket ORDER BY n_words, part, doc_id, piece) - 1 AS place
  FROM pieces p JOIN ends e ON p.n_words > e.below AND p.n_words <= e.bucket_end)
SELECT doc_id, piece::INT AS piece, start::INT AS start, n_words::INT AS n_words, bucket::INT AS bucket,
       bucket_end::INT AS bucket_end, (place // ({budget} // bucket_end))::BIGINT AS batch,
       (bucket_end - n_words)::INT AS padding
FROM placed
"""
