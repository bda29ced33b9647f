"""Near-duplicate passages by compact windows.

A document is the string of its five-word shingles. Under a hash function, the Cartesian tree of the
string's hashes groups all stretches of at least a given length by their least shingle: a node is a compact
window (left, least, right), and each stretch within it that covers the least place has that shingle as its
min-hash. Two passages of 50 words that resemble by 0.8 have one edit in 50 words, so half of what they share, 20
shingles, is a run that is equal in both. The middle 14 of a run have one min-hash in both documents, with three equal
shingles on either side of it: windows of stretches of 14 that are keyed by those seven shingles meet whatever the
function, and one function is enough. (Windows of whole passages meet with a chance equal to their resemblance, and
need many functions.) Windows that meet are linked to that of the smallest document; the links of two documents are
joined as intervals, and in each joined interval the longest stretches that resemble are found word by word. A window
whose link leads to no such stretch may still resemble another one of its group: those carry the shingles around their
least place, and each is compared with all of its group that share rare shingles with it, until one is found or none
is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, need, runs_of, small_or_shuffled, starts_of

SHINGLE, SHARE = 5, 0.8
#: Words in the shortest passage, and hash functions; shingles on either side of the least one that are in a window's key.
LEAST, HASHES, BESIDE = 50, 1, 3
#: Shingles on either side of a window's least place that windows are compared by, as 16 bits each; 0 is beyond the text.
REACH = 49
#: Pairs of windows that are compared at a time, and shingles in other places from which they are aligned.
PAIRS, MOVED = 2_000, 5
#: One document in so many shows which keys are frequent; such keys are dealt to as many parts as give about PART rows each.
SAMPLE, OFTEN, PART = 64, 8, 2_048
_LOW = (1 << 32) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors, so that the order of words counts.
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of shingles; remembers the hashes of a fixed number of words."""

    MOST = 150_000

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def words(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(self.number) > self.MOST:
            self.number, self.hashes = {}, np.zeros(0, np.uint64)
        number = self.number
        at = np.fromiter(map(number.get, found, repeat(-1)), np.int64, len(found))
        if (missing := np.flatnonzero(at < 0)).size:
            new = list(dict.fromkeys(found[i] for i in missing.tolist()))
            number.update(zip(new, range(len(number), len(number) + len(new))))
            if len(number) > self.hashes.size:
                self.hashes = np.concatenate([self.hashes, np.zeros(max(len(number), 1 << 16), np.uint64)])
            self.hashes[len(number) - len(new) : len(number)] = [xxhash.xxh3_64_intdigest(w) for w in new]
            at[missing] = [number[found[i]] for i in missing.tolist()]
        return self.hashes[at]

    def shingles(self, text: str | None, size: int = SHINGLE) -> np.ndarray:
        w = self.words(text)
        n = w.size - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h += w[k : k + n] * _FACTORS[k]
        return _mixed(h)


def word_ends(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``text`` begins and ends, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(points.size + 2, bool)
    inside[1:-1] = (points != 32) & ((points < 9) | (points > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def compact_windows(h: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(left, place of the first least value, right) of all stretches of at least ``least`` places.

    Every such stretch is covered by one window alone: the nodes of the Cartesian tree that are long enough.
    Places that share their least value are taken together, so that a run of one value is passed over once.
    """
    out, todo = [], [(0, h.size, None)]
    while todo:
        a, b, above = todo.pop()
        if b - a < least:
            continue
        part = h[a:b]
        c = a + int(part.argmin())
        if above is not None and h[c] == above:
            ties = (a + np.flatnonzero(part == above)).tolist()
        else:
            ties = [c]
        low, left = h[c], a
        for c in ties:
            if b - left < least:
                break
            out.append((left, c, b - 1))
            todo.append((left, c, None))
            left = c + 1
        # the rest may begin with the same value again
        todo.append((left, b, low if len(ties) == 1 else None))
    return out


def windows(docs: DataFrame, least: int = LEAST, hashes: int = HASHES, share: float = SHARE) -> DataFrame:
    """``key``, ``doc``, ``place``, ``span`` of the compact windows of ``docs`` (``doc``, ``text``).

    A key stands for the function, the least shingle, which is at ``place``, and the shingles beside it. A span
    has the left end in its upper half and the right end in its lower half; it reaches REACH places from the least
    one, as a passage may begin and end beyond its runs. Windows of one key that follow each other in a run of repeated
    words are one. Documents of fewer words than a passage have no windows.
    """
    long = least - SHINGLE + 1
    stretch = max(1, _run(long, share) - 2 * BESIDE)
    seeds = _mixed(np.arange(1, hashes + 1, dtype=np.uint64) * _ODD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids, strings, places = [], [], 0
            for doc, text in zip(batch["doc"].to_pylist(), batch["text"], strict=True):
                if (h := hasher.shingles(text.as_py())).size >= long:
                    ids.append(doc)
                    strings.append(h)
                    places += h.size
                if places > 200_000:
                    yield from keyed(ids, strings)
                    ids, strings, places = [], [], 0
            if strings:
                yield from keyed(ids, strings)

    def keyed(ids: list[int], strings: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The rows of some documents, one function at a time; places are counted through all of them."""
        sizes, h = np.array([x.size for x in strings]), np.concatenate(strings)
        begins = np.cumsum(sizes) - sizes
        # there are no shingles beside a document's ends, whatever documents are read with it
        around = h.copy()
        for k in range(1, BESIDE + 1):
            before, after = np.roll(h, k), np.roll(h, -k)
            for j in range(k):
                before[begins + j], after[begins + sizes - 1 - j] = 0, 0
            around += before * _FACTORS[k] + after * _FACTORS[32 + k]
        for k in range(hashes):
            mixed = _mixed(h ^ seeds[k])
            found = [compact_windows(mixed[b : b + n], stretch) for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
            of = np.repeat(np.arange(sizes.size), [len(f) for f in found])
            left, place, right = np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int64, 3 * of.size).reshape(-1, 3).T
            key = _mixed(around[place + begins[of]] + seeds[k]).view(np.int64)
            # windows of a run of one value follow each other and have one right end
            new = np.ones(of.size, bool)
            new[1:] = (key[1:] != key[:-1]) | (right[1:] != right[:-1]) | (of[1:] != of[:-1])
            left, place, right, of, key = (v[new] for v in (left, place, right, of, key))
            span = (np.maximum(np.minimum(left, place - REACH), 0) << 32) + np.minimum(np.maximum(right, place + REACH), sizes[of] - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, np.array(ids, np.int64)[of], place.astype(np.int32), span)], names=["key", "doc", "place", "span"])

    return docs.select("doc", "text").mapInArrow(run, "key long, doc long, place int, span long")


def aligned(own: np.ndarray, other: np.ndarray, spans: list[tuple[int, int, int, int]], least: int, share: float, shift: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """Verified passages (begin, end, begin, end), in shingles of ``own`` and ``other``, that ``spans`` lead to.

    A span is (left, right) of a window here and there, and ``shift`` how far its least place there is from that
    here. Spans that overlap are joined first. In a joined span, the places that have a shingle in common with the
    other side follow each other on both sides; of all stretches from one such place to another that resemble by
    ``share``, the longest are found at once (:func:`_stretches`). A passage counts if it has enough words and the
    sets of shingles on both sides resemble by ``share``.
    """
    joined: list[list[int]] = []
    for s in sorted((*s, o) for s, o in zip(spans, shift or [s[2] - s[0] for s in spans], strict=True)):
        last = joined[-1] if joined else None
        if last and s[0] <= last[1] and s[2] <= last[3] and s[3] >= last[2]:
            last[1], last[2], last[3] = max(last[1], s[1]), min(last[2], s[2]), max(last[3], s[3])
        else:
            joined.append(list(s))
    out: set[tuple[int, int, int, int]] = set()
    for a0, a1, b0, b1, offset in joined:
        x, y = own[a0 : a1 + 1], other[b0 : b1 + 1]
        part, there = _common(x, y, offset + a0 - b0)
        if not part.size:
            continue
        for lo, hi in _stretches(part, there, least, share):
            a, b, c, d = int(part[lo]), int(part[hi]), int(there[lo : hi + 1].min()), int(there[lo : hi + 1].max())
            if _resemble(x[a : b + 1], y[c : d + 1], share):
                out.add((a0 + a, a0 + b, b0 + c, b0 + d))
            else:  # repeated shingles count once in a set
                out.update((a0 + a, a0 + b, b0 + c, b0 + d) for a, b, c, d in _parts(x, y, part[lo : hi + 1], least, share))
    return sorted(out)


def _common(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``x`` whose shingle ``y`` has, and the places there: of several, that nearest to ``offset`` away."""
    order = np.argsort(y, kind="stable")
    values = y[order]
    lo = np.searchsorted(values, x, "left")
    part = np.flatnonzero(values[np.minimum(lo, values.size - 1)] == x) if values.size else np.zeros(0, np.int64)
    # places there in order of shingle, then place: the wanted place is looked for inside its shingle's part
    first = lo[part]
    group = np.cumsum(np.r_[True, values[1:] != values[:-1]]) - 1 if values.size else first
    wide = 2 * (x.size + y.size) + 2
    code = group * wide + order
    aim = np.clip(part + offset, 0, y.size - 1)
    at = np.searchsorted(code, group[first] * wide + aim, "left")
    after = np.minimum(at, y.size - 1)
    after = np.where(group[after] == group[first], after, np.maximum(at - 1, 0))
    before = np.maximum(at - 1, 0)
    before = np.where(group[before] == group[first], before, after)
    there = np.where(np.abs(order[before] - aim) <= np.abs(order[after] - aim), order[before], order[after])
    return part, there


def _resemble(x: np.ndarray, y: np.ndarray, share: float) -> bool:
    p, q = np.unique(x), np.unique(y)
    both = np.intersect1d(p, q, assume_unique=True).size
    return both >= share * (p.size + q.size - both) - 1e-9


def _stretches(part: np.ndarray, there: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """First and last index of stretches of common places that resemble; together they cover what all such stretches do.

    From index i to j there are j - i + 1 common shingles in ``part[j] - part[i] + 1`` places here and as many there
    as the way from ``there[i]`` to ``there[j]`` is long. So the share is reached where a sum over places, which rises
    by common shingles and falls by all, is not lower at j than at i. For each i the last such j is found in sorted
    suffix maxima; stretches inside others are left out, and of those that overlap as few as cover the same are kept.
    """
    n = np.arange(part.size)
    out: list[tuple[int, int]] = []
    for way in (np.r_[0, np.cumsum(np.abs(np.diff(there)))], part - part[0]):
        rise = (1 + share) * n - share * (part + way)
        top = np.maximum.accumulate(rise[::-1])[::-1]
        # top falls, so that the last index with top >= rise - (1 - share) is found by bisection
        last = part.size - 1 - np.searchsorted(top[::-1], rise - (1 - share) - 1e-9, "left")
        last = np.maximum(last, n)
        long = part[last] - part + SHINGLE >= least
        best = np.flatnonzero(long & (last > np.r_[-1, np.maximum.accumulate(last)[:-1]]))
        kept: list[tuple[int, int]] = []
        for i, j in zip(best.tolist(), last[best].tolist(), strict=True):
            # the last but one kept reaches this one: the last adds nothing
            while len(kept) > 1 and kept[-2][1] + 1 >= i:
                kept.pop()
            kept.append((i, j))
        out += [k for k in kept if not any(a <= k[0] and k[1] <= b for a, b in out)]
    return out


def _ends(own: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Left and right ends, here and there, of packed spans."""
    return list(zip((own >> 32).tolist(), (own & _LOW).tolist(), (other >> 32).tolist(), (other & _LOW).tolist(), strict=True))


def _parts(x: np.ndarray, y: np.ndarray, part: np.ndarray, least: int, share: float) -> Iterator[tuple[int, int, int, int]]:
    """Passages from the first to the last place of ``part`` or, where that does not count, of its halves about the widest gap."""
    order = np.argsort(y, kind="stable")
    there = order[np.searchsorted(y[order], x[part])]
    todo = [(0, part.size)]
    while todo:
        lo, hi = todo.pop()
        if hi <= lo or part[hi - 1] - part[lo] + SHINGLE < least:
            continue
        a, b, spots = int(part[lo]), int(part[hi - 1]), there[lo:hi]
        # places there that belong together: those about the median offset
        off = spots - part[lo:hi]
        near = spots[np.abs(off - np.median(off)) <= max(8, (b - a) // 4)]
        if near.size:
            c, d = int(near.min()), int(near.max())
            p, q = np.unique(x[a : b + 1]), np.unique(y[c : d + 1])
            both = np.intersect1d(p, q, assume_unique=True).size
            if both >= share * (p.size + q.size - both):
                yield a, b, c, d
                continue
        gaps = np.diff(part[lo:hi])
        # without a gap here, the other side is interrupted
        cut = lo + 1 + int((gaps if gaps.max() > 1 else np.abs(np.diff(off))).argmax())
        todo += [(lo, cut), (cut, hi)]


def passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, share: float = SHARE, hashes: int = HASHES
) -> DataFrame:
    """``doc_id``, ``begin``, ``end`` (code points), ``first_doc_id``, ``is_first``, ``text_hash``: every passage that repeats.

    Passages of at least ``least`` words whose sets of five-word shingles resemble by ``share`` are near
    duplicates (lower-cased words). Each is named with a smaller document that it was verified against; the
    passage there is returned with ``is_first``, which says no more than that another one names it. Equal texts are
    compared once: the smallest id stands for them, and each other copy is a passage as a whole. Repeats inside
    one document are left alone. Whole texts are read. Null, empty and short texts have no passages; rows without
    an id are left out. Ids are whole numbers; others are an error. Rows that repeat id and text count once. Rows
    that share an id alone are documents of their own, which ``text_hash`` tells apart; the one with the least hash
    has the id's place in the order, the others come after all ids.
    """
    ids = _identified(docs, id_col, text_col)
    distinct, copies = _distinct_texts(docs, ids, id_col, text_col)
    met = checkpointed(_met(distinct, least, hashes, share))
    found = checkpointed(_verified(distinct, _marks(met), least, share))
    again = _others(distinct, met, found, least, share)
    if again is not None:
        found = found.unionByName(checkpointed(_verified(distinct, _marks(again), least, share)))
    found = found.where("begin IS NOT NULL")
    # whole copies; texts below the least number of words are no passages
    enough = _long_enough(distinct.join(small_or_shuffled(copies.where("doc = first").select("doc")), "doc", "left_semi"), least)
    whole = copies.join(small_or_shuffled(checkpointed(enough.withColumnRenamed("doc", "first"))), "first").select(
        "doc", F.lit(0).alias("begin"), F.col("chars").alias("end"), "first", (F.col("doc") == F.col("first")).alias("is_first")
    )
    own = found.select("doc", "begin", "end", "first", F.lit(False).alias("is_first"))
    there = found.select(F.col("first").alias("doc"), F.col("first_begin").alias("begin"), F.col("first_end").alias("end"), "first", F.lit(True).alias("is_first"))
    every = own.unionByName(there).unionByName(whole).distinct()
    names = ids.select("doc", F.col("id").alias("doc_id"), F.col("x").alias("text_hash"))
    return every.join(names, "doc").join(names.select(F.col("doc").alias("first"), F.col("doc_id").alias("first_doc_id")), "first").select(
        "doc_id", "begin", "end", "first_doc_id", "is_first", "text_hash"
    )


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc`` (a number of its own), ``id``, ``x``, ``y`` (hashes of the text), ``chars``, ``rows`` of every id and text."""
    each = checkpointed(_hashed(docs, id_col, text_col).groupBy("id", "x", "y").agg(F.max(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("rows")))
    shared = checkpointed(each.groupBy("id").agg(F.count(F.lit(1)).alias("texts"), F.min("x").alias("least")).where("texts > 1"))
    if shared.isEmpty():
        return each.withColumn("doc", F.col("id"))
    above = each.agg(F.max("id").alias("m")).collect()[0].m
    other = checkpointed(each.join(small_or_shuffled(shared), "id").where("x <> least").select("id", "x", "y", F.monotonically_increasing_id().alias("n")))
    return checkpointed(each.join(small_or_shuffled(other), ["id", "x", "y"], "left").withColumn("doc", F.coalesce(F.col("n") + F.lit(above + 1), F.col("id"))).drop("n"))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text`` and two hashes that stand for the text, which is not shuffled for this."""
    rows = need(docs, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"))


def _distinct_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc``, ``text`` of one document for each text; and ``doc``, ``first``, ``chars`` of those with copies."""
    firsts = checkpointed(ids.groupBy("x", "y").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    copies = checkpointed(ids.join(small_or_shuffled(firsts), ["x", "y"]).select("doc", "id", "x", "y", "first", "chars"))
    key, rows = ["id", "x", "y"], _hashed(docs, id_col, text_col)
    later = copies.where("doc <> first").select(*key)
    rows = rows.join(small_or_shuffled(later), key, "left_anti")
    twice = checkpointed(ids.where("rows > 1").select(*key))
    if not twice.isEmpty():
        twice = small_or_shuffled(twice)
        rows = rows.join(twice, key, "left_anti").unionByName(rows.join(twice, key, "left_semi").dropDuplicates(key))
    other = checkpointed(ids.where("doc <> id").select(*key, "doc"))
    if other.isEmpty():
        return rows.select(F.col("id").alias("doc"), "text"), copies
    return rows.join(small_or_shuffled(other), key, "left").select(F.coalesce("doc", "id").alias("doc"), "text"), copies


def _sampled():
    """One document in SAMPLE, by hash: shows which keys are frequent, and decides nothing else."""
    return F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0


_WINDOW = "key long, salt long, doc long, place int, span long"
_LINK = f"{_WINDOW}, first long, first_place int, first_span long"


def _met(docs: DataFrame, least: int, hashes: int, share: float) -> DataFrame:
    """Windows linked to that of the smallest document in their group: the columns of _LINK.

    Windows are shuffled once. A key that the sampled documents have often is dealt to parts; the parts' first
    windows are then linked to the first of all, so that a chain joins every window. A task holds one batch.
    """
    counted = windows(docs.where(_sampled()), least, hashes, share).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    often = checkpointed(counted.select("key", F.ceil(F.col("n") * SAMPLE / PART).cast("long").alias("parts")).where("parts > 1"))
    salted = windows(docs, least, hashes, share).join(small_or_shuffled(often), "key", "left").select(
        "key", F.when(F.col("parts").isNotNull(), 1 + F.pmod(F.xxhash64("doc", F.lit("salt")), F.col("parts"))).otherwise(F.lit(0)).alias("salt"), "doc", "place", "span"
    )

    def to_first(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc", "place").mapInArrow(_to_first, _LINK)

    found = checkpointed(to_first(salted))
    # the first of each part of a frequent key, once more under one salt
    tops = found.where("salt > 0 AND doc = first").select("key", F.lit(0).cast("long").alias("salt"), "doc", "place", "span")
    return found.unionByName(to_first(tops)).where("doc > first")


def _to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of larger documents beside the first row of their run; of salted runs, the first row itself as well."""
    names = ["key", "salt", "doc", "place", "span"]
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[c].to_numpy() for c in names]
        new = starts_of(pa.Table.from_batches([batch]), ["key", "salt"])
        goes_on = held is not None and held[0] == columns[0][0] and held[1] == columns[1][0]
        new[0] = not goes_on
        # the run that goes on has its first row before this batch's rows
        first = [np.r_[h, c] for h, c in zip(held or [c[0] for c in columns], columns, strict=True)]
        at = np.maximum.accumulate(np.where(new, np.arange(1, new.size + 1), 0))
        first = [f[at] for f in first]
        held = [f[-1] for f in first]
        keep = (columns[2] > first[2]) | (new & (columns[1] > 0))
        if keep.any():
            got = [c[keep] for c in (*columns, *first[2:])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, [*kinds, *kinds[2:]], strict=True)], names=[*names, "first", "first_place", "first_span"])


def _marks(links: DataFrame) -> DataFrame:
    """For each two documents the windows that link them: as many as the smaller text can have."""
    return checkpointed(links.groupBy("doc", "first").agg(F.collect_set(F.struct("place", "span", "first_place", "first_span")).alias("spans")))


def _others(docs: DataFrame, met: DataFrame, found: DataFrame, least: int, share: float) -> DataFrame | None:
    """Links, to others of their group, of windows of ``met`` whose own link led to no passage over their place.

    Groups of two have no others; None if there is nothing to link. The rows of a group that has such a window
    carry the shingles around their least place and are compared (:func:`_linked`). Groups of more than PART rows
    are dealt to parts by count; a window that finds nothing in its own part then looks in all the others, so that
    a group of n windows that resemble nothing costs n * n / PART rows.
    """
    passed = found.where("begin IS NOT NULL").groupBy("doc").agg(F.collect_set(F.struct("at", "to")).alias("passed"))
    lost = found.where("begin IS NULL").select("doc", "first", F.explode("lost").alias("place")).join(passed, "doc", "left").where(
        ~F.coalesce(F.exists("passed", lambda p: (p["at"] <= F.col("place")) & (F.col("place") <= p["to"])), F.lit(False))
    ).select("doc", "first", "place")
    lost = checkpointed(lost.distinct())
    if lost.isEmpty():
        return None
    seeking = met.join(small_or_shuffled(lost), ["doc", "first", "place"], "left_semi").select("key", "doc", "place").distinct()
    seeking = checkpointed(seeking)
    keys = small_or_shuffled(checkpointed(seeking.select("key").distinct()))
    some = met.join(keys, "key", "left_semi")
    group = some.select("key", "doc", "place", "span").unionByName(some.select("key", F.col("first").alias("doc"), F.col("first_place").alias("place"), F.col("first_span").alias("span"))).distinct()
    group = checkpointed(group)
    sizes = group.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc").alias("docs")).where("n > 2")
    sizes = checkpointed(sizes.select("key", F.ceil(F.col("n") / PART).cast("long").alias("parts")))
    if sizes.isEmpty():
        return None
    rows = group.join(small_or_shuffled(sizes), "key").join(
        small_or_shuffled(seeking.withColumn("seeks", F.lit(True))), ["key", "doc", "place"], "left"
    ).select("key", F.when(F.col("parts") > 1, 1 + F.pmod(F.xxhash64("doc", F.lit("salt")), F.col("parts"))).otherwise(F.lit(0)).alias("salt"), "doc", "place", "span", F.coalesce("seeks", F.lit(False)).alias("seeks"))
    by_doc = checkpointed(rows.groupBy("doc").agg(F.collect_list(F.struct("key", "salt", "place", "span", "seeks")).alias("windows")))

    def around(some: DataFrame) -> DataFrame:
        texts = docs.join(small_or_shuffled(some.select("doc")), "doc", "left_semi")
        return some.join(texts, "doc").select("doc", "windows", "text").mapInArrow(_around, f"{_WINDOW}, seeks boolean, around binary")

    def linked(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in runs_of(batches, ["key", "salt"]):
                yield _linked(part, least - SHINGLE + 1, share)

        return checkpointed(rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc", "span").mapInArrow(
            run, f"{_WINDOW}, around binary, first long, first_place int, first_span long"
        ))

    out = linked(around(by_doc))
    own = out.where("first IS NULL").join(small_or_shuffled(sizes.where("parts > 1")), "key")
    seekers = own.select("key", F.col("salt").alias("own"), "doc", "place", "span", "around", F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("salt"))
    if not seekers.isEmpty():
        dealt = around(by_doc.withColumn("windows", F.filter("windows", lambda w: w["salt"] > 0)).where(F.size("windows") > 0)).withColumn("seeks", F.lit(False))
        out = out.unionByName(linked(dealt.unionByName(seekers.where("salt <> own").withColumn("seeks", F.lit(True)).drop("own"))))
    return out.where("first IS NOT NULL").drop("around")


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with the shingles around their least place; spans reach as far as these."""
    hasher = Hasher()
    for batch in batches:
        ends = batch["windows"].offsets.to_numpy()
        fields = [batch["windows"].values.field(k).to_numpy(zero_copy_only=False) for k in range(5)]
        for i, (doc, text) in enumerate(zip(batch["doc"].to_pylist(), batch["text"], strict=True)):
            h = hasher.shingles(text.as_py())
            short = np.concatenate([np.zeros(REACH, np.uint16), (h % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16), np.zeros(REACH, np.uint16)])
            for lo in range(int(ends[i]), int(ends[i + 1]), 20_000):
                key, salt, place, span, seeks = (f[lo : min(lo + 20_000, int(ends[i + 1]))] for f in fields)
                near = np.lib.stride_tricks.sliding_window_view(short, 2 * REACH + 1)[place]
                wide = place.astype(np.int64)
                span = (np.maximum(np.minimum(span >> 32, wide - REACH), 0) << 32) + np.minimum(np.maximum(span & _LOW, wide + REACH), h.size - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(salt), pa.array(np.full(key.size, doc)), pa.array(place, pa.int32()), pa.array(span), pa.array(seeks, pa.bool_()), pa.array([x.tobytes() for x in near], pa.binary())],
                    names=["key", "salt", "doc", "place", "span", "seeks", "around"],
                )


def _linked(rows: pa.Table, long: int, share: float) -> pa.RecordBatch:
    """Links of the rows that seek to rows of smaller documents of their run; salted rows that find none, with null.

    Of two passages that resemble by ``share`` a number of distinct shingles are in both, so that each has one
    of them among its rarest: all but that number, less one. Rows with such a shingle in common are compared,
    those of one shingle from the smallest document on, until the seeking row has a passage over its least
    place that resembles.
    """
    key, salt, doc, place_of, span = (rows[c].to_numpy() for c in ("key", "salt", "doc", "place", "span"))
    seeks, n, width = rows["seeks"].to_numpy(), rows.num_rows, 2 * REACH + 1
    near = np.frombuffer(b"".join(rows["around"].to_pylist()), np.uint16).reshape(n, width)
    run, run_least = np.cumsum(starts_of(rows, ["key", "salt"])) - 1, _run(long, share)
    fresh, enough = _distinct(near, long, share)
    size = fresh.sum(1)
    plain = size == (near != 0).sum(1)
    of = np.repeat(np.arange(n), size)
    code = (run[of] << 16) + near[fresh]
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    by = np.lexsort((code, count[at], of))
    place = np.arange(of.size) - np.repeat(np.cumsum(size) - size, size)
    by = by[place <= size[of] - enough[of]]
    of, code = of[by], code[by]
    by = np.lexsort((of, code))
    of, code = of[by], code[by]
    # the rows of smaller documents that have a row's shingle: from begin to end
    new = np.r_[True, code[1:] != code[:-1]][: of.size]
    other = new | np.r_[True, doc[of][1:] != doc[of][:-1]][: of.size]
    begin, end = (np.flatnonzero(x)[np.cumsum(x) - 1] for x in (new, other))
    open_, entry, at = seeks.copy(), np.arange(of.size), begin
    out, seen, steps = [np.zeros((2, 0), np.int64)], np.zeros(0, np.int64), 1
    while True:
        left = open_[of[entry]] & (at[entry] < end[entry])
        entry = entry[left]
        if not entry.size:
            break
        # all rows take a few steps; more of them, the fewer rows there are
        many = np.minimum(end[entry] - at[entry], steps)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        here, there = np.repeat(of[entry], many), of[np.repeat(at[entry], many) + step]
        at[entry] += many
        pairs = np.unique(here * n + there)
        pairs = pairs[~np.isin(pairs, seen)]
        seen = np.concatenate([seen[open_[seen // n]], pairs])
        for lo in range(0, pairs.size, PAIRS):
            i, j = np.divmod(pairs[lo : lo + PAIRS], n)
            i, j = i[open_[i]], j[open_[i]]
            x, y = near[i], near[j]
            same = (x == y) & (x != 0)
            # places about the least one that are equal in a row
            before = np.logical_and.accumulate(same[:, REACH::-1], axis=1).sum(1)
            equal = before + np.logical_and.accumulate(same[:, REACH:], axis=1).sum(1) - 1 >= long
            out.append(np.stack([i[equal], j[equal]]))
            open_[i[equal]] = False
            # two passages of 50 words that resemble have a run of shingles in common (_run); windows that have
            # it around their least place are told by equal places, and others have windows of their own there
            long_run = same.sum(1) >= run_least
            i, j, x, y, same = i[long_run], j[long_run], x[long_run], y[long_run], same[long_run]
            sure = np.flatnonzero(open_[i])
            sure = sure[_edited(same[sure], fresh[i[sure]] & fresh[j[sure]], long, share)]
            out.append(np.stack([i[sure], j[sure]]))
            open_[i[sure]] = False
            unsure = np.flatnonzero(open_[i])
            common = ((x[unsure, :, None] == y[unsure, None, :]).any(2) & fresh[i[unsure]]).sum(1)
            many = common >= np.maximum(enough[i], enough[j])[unsure]
            unsure, common = unsure[many], common[many]
            exact = _edited(same[unsure], fresh[i[unsure]] & fresh[j[unsure]], long, share, 1)
            out.append(np.stack([i[unsure[exact]], j[unsure[exact]]]))
            open_[i[unsure[exact]]] = False
            # without repeated shingles, and few in other places, there is nothing that place by place does not tell
            moved = (common - same[unsure].sum(1) >= MOVED) | ~plain[i[unsure]] | ~plain[j[unsure]]
            for k in unsure[moved & ~exact].tolist():
                if open_[i[k]] and _over_least(x[k], y[k], long, share):
                    open_[i[k]] = False
                    out.append(np.array([[i[k]], [j[k]]]))
        steps = max(1, min(2 * steps, 200_000 // entry.size))
    i, j = np.concatenate(out, axis=1)
    # what has not found a passage looks in the other parts
    rest = np.flatnonzero(open_ & (salt > 0) & seeks) if n else np.zeros(0, np.int64)
    here = np.r_[i, rest]
    none = np.r_[np.zeros(i.size, bool), np.ones(rest.size, bool)]
    to = np.r_[j, rest]
    around = pa.concat_arrays([pa.nulls(i.size, pa.binary()), pa.array([near[r].tobytes() for r in rest], pa.binary())])
    return pa.RecordBatch.from_arrays(
        [pa.array(key[here]), pa.array(salt[here]), pa.array(doc[here]), pa.array(place_of[here], pa.int32()), pa.array(span[here]), around, pa.array(doc[to], mask=none), pa.array(place_of[to], pa.int32(), mask=none), pa.array(span[to], mask=none)],
        names=["key", "salt", "doc", "place", "span", "around", "first", "first_place", "first_span"],
    )


def _run(long: int, share: float) -> int:
    """The length of the longest run that two passages of ``long`` shingles have in common at least, if one edit parts them:
    half of the shingles that both have, of which there are 2 share / (1 + share) of all."""
    return int(long * share / (1 + share))


def _distinct(near: np.ndarray, long: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The places where a shingle is the first of its kind in a row; how many a passage over the least place shares."""
    n, width = near.shape
    order = np.argsort(near, axis=1, kind="stable")
    value = np.take_along_axis(near, order, 1)
    again = value[:, 1:] == value[:, :-1]
    # the place before that has the same shingle
    prior = np.full((n, width), -1, np.int16)
    rest = np.where(again, order[:, :-1], -1).astype(np.int16)
    np.put_along_axis(prior, order[:, 1:], rest, 1)
    least = np.full(n, long)
    for lo in range(max(0, REACH - long + 1), REACH + 1):
        part = slice(lo, lo + long)
        some = (prior[:, part] < lo).sum(1)
        least = np.where((near[:, part] != 0).all(1), np.minimum(least, some), least)
    return (prior < 0) & (near != 0), np.maximum(1, np.ceil(share * least - 1e-9)).astype(np.int64)


def _edited(same: np.ndarray, fresh: np.ndarray, long: int, share: float, step: int = 4) -> np.ndarray:
    """True where a stretch over the least place, without repeated shingles, resembles place by place."""
    equal, once = (np.pad(np.cumsum(x, axis=1, dtype=np.int16), ((0, 0), (1, 0))) for x in (same, fresh))
    found = np.zeros(len(same), bool)
    for size in range(long, 2 * REACH + 2, step):
        lo = np.arange(max(0, REACH - size + 1), min(REACH, 2 * REACH + 1 - size) + 1)
        common = equal[:, lo + size] - equal[:, lo]
        found |= ((common >= share * (2 * size - common)) & (once[:, lo + size] - once[:, lo] == size)).any(1)
    return found


def _over_least(x: np.ndarray, y: np.ndarray, long: int, share: float) -> bool:
    """True if a passage over the least place of ``x`` and ``y`` resembles."""
    a, b = np.flatnonzero(x), np.flatnonzero(y)
    at, to = REACH - int(a[0]), REACH - int(b[0])
    x, y = x[a], y[b]
    return any(p <= at <= q and r <= to <= s for p, q, r, s in aligned(x, y, [(0, x.size - 1, 0, y.size - 1)], long + SHINGLE - 1, share, [to - at]))


def _long_enough(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [len(t.as_py().encode("utf-8", "surrogatepass").split()) >= least for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc"].filter(pa.array(keep, pa.bool_()))], names=["doc"])

    return docs.mapInArrow(run, "doc long")


def _verified(docs: DataFrame, marks: DataFrame, least: int, share: float) -> DataFrame:
    """The passages that the marked spans lead to, in code points of both texts and (``at``, ``to``) shingles of the first.

    For two documents with windows whose least place is in no such passage, one more row has those places (``lost``).
    """
    def texts(side: str) -> DataFrame:
        """The texts of one side alone, read again rather than kept."""
        return docs.select(F.col("doc").alias(side), F.col("text").alias(f"{side}_text")).join(
            small_or_shuffled(checkpointed(marks.select(side).distinct())), side, "left_semi"
        )

    pairs = marks.join(texts("doc"), "doc").join(texts("first"), "first")
    names = ["doc", "first", "begin", "end", "first_begin", "first_end", "at", "to", "lost"]
    kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, kept, y, other = Hasher(), None, None, None
        for batch in batches:
            out = []
            ends = batch["spans"].offsets.to_numpy()
            place, span, place_there, there = (batch["spans"].values.field(k).to_numpy() for k in range(4))
            for i, (doc, first, text, first_text) in enumerate(zip(*(batch[c] for c in ("doc", "first", "doc_text", "first_text")), strict=True)):
                text, first, doc = text.as_py(), first.as_py(), doc.as_py()
                if first != kept:  # rows of one first document follow each other
                    other = first_text.as_py()
                    kept, y = first, hasher.shingles(other)
                x, some = hasher.shingles(text), slice(ends[i], ends[i + 1])
                got = aligned(x, y, _ends(span[some], there[some]), least, share, (place_there[some].astype(np.int64) - place[some]).tolist())
                lost = np.unique(place[some])
                for a, b, _, _ in got:
                    lost = lost[(lost < a) | (lost > b)]
                if got:
                    (at, to), (at_there, to_there) = word_ends(text), word_ends(other)
                    out += [
                        (doc, first, int(at[a]), int(to[b + SHINGLE - 1]), int(at_there[c]), int(to_there[d + SHINGLE - 1]), a, b, None)
                        for a, b, c, d in got
                    ]
                if lost.size:
                    out.append((doc, first, None, None, None, None, None, None, lost.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    cols = pairs.select("doc", "first", "spans", "doc_text", "first_text")
    return cols.mapInArrow(run, "doc long, first long, begin int, end int, first_begin int, first_end int, at int, to int, lost array<int>")


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the code points of ``spans``, which may overlap; what is left keeps its order."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : max(at, a)])
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **how: object) -> DataFrame:
    """``docs``, all columns, without the passages that repeat one of a document with a smaller id.

    A passage stays where it is first, and clean documents stay as they are. ``chars_col``, if given and
    present, gets the new length of texts that change. A document of which nothing but white space is left
    stays with that text. Rows are cut by id and text, so that rows that share an id alone are cut each by itself.
    """
    found = passages(docs, id_col, text_col, **how).where("NOT is_first")
    # spans of a document are no more than its words
    spans = checkpointed(found.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set(F.struct("begin", "end")).alias("__spans")))
    here = (F.col(f"`{id_col}`").cast("long") == F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__hash"))
    both = docs.join(spans, here, "left").drop("__id", "__hash")
    at = both.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            texts, sizes = [], []
            for text, spans_ in zip(columns[at], batch["__spans"], strict=True):
                t, s = text.as_py(), spans_.as_py()
                changed = t is not None and bool(s)
                t = cut_out(t, [(x["begin"], x["end"]) for x in s]) if changed else t
                texts.append(t)
                sizes.append(len(t) if changed else None)
            columns[at] = pa.array(texts, pa.string())
            if chars_col in batch.schema.names:
                i = batch.schema.names.index(chars_col)
                new = pa.array(sizes, columns[i].type)
                columns[i] = pa.compute.coalesce(new, columns[i])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    import pyarrow.compute  # noqa: F401  used by run

    return both.mapInArrow(run, docs.schema)
