"""Document fingerprints by locally consistent parsing.

A text is a string of symbols, at first its code points. A round of deterministic coin tossing
compares each symbol with its left neighbour and names it by the lowest bit in which both differ;
after a few rounds equal neighbours have gone and names are below six, so the places whose name is
a local maximum cut the string into phrases of a few symbols. Each phrase is named by a hash of its
symbols, and the names are the next level's string. Where a cut falls depends on a few symbols on
either side alone, so equal substrings are parsed alike, whatever stands before them, but for their
margins. A fingerprint is the bottom sketch of the phrase names of all levels from the second on: phrases
of some ten, thirty and a hundred characters, so that long equal stretches count on every level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import need, small_or_shuffled

#: Names kept in a sketch, levels of phrases, and hex digits of a name.
SKETCH, LEVELS, DIGITS = 64, 4, 12
#: The driver holds a cut and a head for each part, and the plan a comparison.
MOST_PARTS = 4096
#: Rounds of coin tossing that bring 64-bit symbols below six: 64 bits, then 7, 4, 3 and 3.
_ROUNDS = 4
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _lowest(x: np.ndarray) -> np.ndarray:
    """The place of the lowest bit that is set; ``x`` has no zero."""
    return np.bitwise_count((x & (np.uint64(0) - x)) - np.uint64(1)).astype(np.uint64)


def _tossed(symbols: np.ndarray) -> np.ndarray:
    """Names below six, such that neighbours differ; neighbouring ``symbols`` differ.

    The first symbol, which has no left neighbour, is compared with its own complement's low bit.
    """
    names = symbols
    for _ in range(_ROUNDS):
        left = np.empty_like(names)
        left[1:] = names[:-1]
        left[0] = names[0] ^ np.uint64(1)
        at = _lowest(names ^ left)
        names = (at << np.uint64(1)) | ((names >> at) & np.uint64(1))
    return names


def _phrases(symbols: np.ndarray) -> np.ndarray:
    """The names of the next level's string."""
    # runs of one symbol become one symbol that holds its length, so that neighbours differ
    first = np.r_[True, symbols[1:] != symbols[:-1]]
    at = np.flatnonzero(first)
    long = np.diff(np.r_[at, symbols.size])
    runs = symbols[at]
    many = long > 1
    if many.any():
        runs = runs.copy()
        runs[many] = _mixed(runs[many] + _mixed(long[many].astype(np.uint64)))
        if (runs[1:] == runs[:-1]).any():
            return _phrases(runs)
    names = _tossed(runs)
    cut = np.zeros(runs.size, bool)
    cut[0] = True
    if runs.size > 2:
        cut[1:-1] = (names[1:-1] > names[:-2]) & (names[1:-1] > names[2:])
    begin = np.flatnonzero(cut)
    place = (np.arange(runs.size) - np.repeat(begin, np.diff(np.r_[begin, runs.size]))).astype(np.uint64)
    return _mixed(np.add.reduceat(_mixed(runs + (place + np.uint64(1)) * _MIX[1]), begin))


def parsed(text: str | None, levels: int = LEVELS) -> list[np.ndarray]:
    """The string of names at each level from 1 to ``levels``; fewer once a string is one name."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out: list[np.ndarray] = []
    names = _mixed(points + np.uint64(1))
    while names.size and len(out) < levels:
        names = _phrases(names)
        out.append(names)
        if names.size == 1:
            break
    return out


def fingerprint(text: str | None, size: int = SKETCH, levels: int = LEVELS) -> str:
    """The ``size`` least names of all levels from the second on as fixed-width hex, smallest first.

    A name is bound to its level. A text that is a single name at the first level has that one. Null and empty
    text give "".
    """
    strings = parsed(text, levels)
    if not strings:
        return ""
    bound = [_mixed(names + np.array([k], np.uint64) * _MIX[0]) for k, names in enumerate(strings, 1) if k > 1 or len(strings) == 1]
    names = np.unique(np.concatenate(bound) >> np.uint64(64 - 4 * DIGITS))[:size]
    return "".join(f"{x:0{DIGITS}x}" for x in names.tolist())


def likeness(a: str, b: str, size: int = SKETCH) -> float:
    """An estimate of the shared part of the phrases of two texts on all levels, from 0 to 1.

    Equal fingerprints give 1, also two empty ones; an empty and another one give 0.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = ({f[i : i + DIGITS] for i in range(0, len(f), DIGITS)} for f in (a, b))
    low = set(sorted(x | y)[:size])
    return len(low & x & y) / len(low)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` of every whole text; null text is as empty."""
    rows = need(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([fingerprint(t.as_py()) for t in batch["text"]], pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def edit_robustness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document is the one before it by id; after the smallest id comes the largest. Ids are
    ranged into ``parts`` (four for each shuffle partition, MOST_PARTS at most) by approximate
    quantiles, which decide the work's division alone; each part is sorted and read in one pass that
    holds one document at a time, so a part can be of any size. The first document of each part is
    dealt to the part before it as well. The text is shuffled once.

    Rows with one id follow each other by text; null ids come last, and null text is as empty text.
    A single row is its own next one; an empty table gives an empty result.
    """
    rows = need(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    parts = parts or min(MOST_PARTS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(ids.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []), reverse=True)
    # part 0 has the largest ids; a null id belongs to the last part
    bounds = [int(c) for c in cuts]
    part = F.coalesce(_part_of(F.col("doc_id"), bounds), F.lit(len(bounds)))
    heads = ids.select("doc_id", part.alias("part")).groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()
    if not heads:
        heads = [(0, None)]
    # at most one row for each part, so both lists are bounded by the number of parts
    before = [(heads[i][0], heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    marks = docs.sparkSession.createDataFrame(before, "part int, head long, earlier int")
    dealt = rows.withColumn("part", part).join(small_or_shuffled(marks), "part", "left").select(
        "doc_id", "text", F.explode(F.when(
            F.col("doc_id").eqNullSafe(F.col("head")),
            F.array(F.struct("part", F.lit(False).alias("extra")), F.struct(F.col("earlier").alias("part"), F.lit(True).alias("extra"))),
        ).otherwise(F.array(F.struct("part", F.lit(False).alias("extra"))))).alias("to"),
    ).select("to.part", "to.extra", "doc_id", "text")
    # the extra copies come after a part's own rows
    order = [F.col("part"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None
        for batch in batches:
            out: list[tuple] = []
            for p, extra, doc, text in zip(*(batch[c] for c in ("part", "extra", "doc_id", "text")), strict=True):
                p, extra, doc, text = p.as_py(), extra.as_py(), doc.as_py(), text.as_py()
                own = fingerprint(text)
                if held and held[0] == p:
                    changed = edited(held[2], text)
                    other = fingerprint(changed)
                    out.append((held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), held[3], other, likeness(held[3], other), likeness(held[3], own)))
                # only the first extra row follows a part's own rows
                held = None if extra else (p, doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch["doc_id"].type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=names)

    return (
        dealt.repartition("part").sortWithinPartitions(*order)
        .mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )


def _part_of(value, cuts: list[int]):
    """How many of the falling ``cuts`` are at least ``value``: a balanced tree of comparisons."""
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(value.isNotNull(), tree(0, len(cuts)))
