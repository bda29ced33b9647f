"""SimHash near-duplicates, found by bit-sliced comparison inside blocks.

Fingerprints are 64 bits. Two that differ in at most two bits agree in at least two of their four
16-bit bands, so blocks are keyed by pairs of bands. A block with many fingerprints is keyed again
by pairs of the four 8-bit bands of its other 32 bits; then 48 bits are fixed, and no block has
more than 65,536 fingerprints, whatever the input. Inside blocks, bit planes are stored vertically
(a word holds one bit of 64 fingerprints) and distances to 64 fingerprints grow at once in
carry-save counters; words whose 64 distances all exceed the radius are abandoned on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import (
    by_batch, checkpointed, components, local_roots, need, runs_of, small_or_shuffled, split_words, starts_of,
)

SEED = 42
#: The band pairs find all links up to this many differing bits.
MOST_RADIUS = 2
#: Blocks above this many fingerprints are keyed once more.
BLOCK = 512
#: Words of 64 lanes that are compared at a time: bounds the memory for links to 64 times as many.
_AT_ONCE = 1 << 16
_BELOW = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit i is 1 if it is 1 in over half of the shingles' hashes; a text without words gives 0."""
    w = split_words(text)
    if not w:
        return 0
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    whole = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[: -shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[i : j - 1], SEED) for i, j in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, h.size, 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > h.size, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of every row, whole texts.

    Null or blank text: 0. Fewer words than a shingle: the whole sequence is the one shingle.
    Repeated rows and null ids stay as they are; an empty table gives an empty result.
    """

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch["text"]), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = need(docs, doc_id=id_col, text=text_col)
    return by_batch(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _sliced(fp: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bit planes, in which a word holds one bit of 64 fingerprints of a block, and the lanes that are filled;
    the first word of each block, the block of each row and the first row of each block."""
    n = fp.size
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[start, n])
    base = np.r_[0, np.cumsum((sizes + 63) // 64)]
    of = np.repeat(np.arange(start.size), sizes)
    place = np.arange(n) - start[of]
    word, lane = base[of] + place // 64, (place % 64).astype(np.uint64)
    planes = np.zeros((64, int(base[-1])), np.uint64)
    filled = np.zeros(int(base[-1]), np.uint64)
    np.bitwise_or.at(filled, word, np.uint64(1) << lane)
    for bit in range(64):
        np.bitwise_or.at(planes[bit], word, ((fp >> np.uint64(bit)) & np.uint64(1)) << lane)
    return planes, filled, base, of, start


def sliced_links(fp: np.ndarray, block: np.ndarray, radius: int = MOST_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``a``, ``b`` that join, in each block, all fingerprints linked by at most ``radius`` bits.

    ``block`` is sorted. Links are reduced to a spanning forest chunk by chunk, so memory stays
    within a constant of the rows and of one chunk. ``radius`` is at most 2.
    """
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"radius is from 0 to {MOST_RADIUS}")
    n = fp.size
    planes, filled, base, of, start = _sliced(fp, block)
    word = base[of] + (np.arange(n) - start[of]) // 64
    # a row meets the words of its block from its own on
    count = base[of + 1] - word
    ends = np.cumsum(count)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _AT_ONCE, "right")))
        rows = np.repeat(np.arange(lo, hi), count[lo:hi])
        step = np.arange(rows.size) - np.repeat(ends[lo:hi] - count[lo:hi] - (ends[lo - 1] if lo else 0), count[lo:hi])
        at = word[rows] + step
        ones, twos, over = (np.zeros(rows.size, np.uint64) for _ in range(3))
        for bit in range(64):
            d = planes[bit, at] ^ (np.uint64(0) - ((fp[rows] >> np.uint64(bit)) & np.uint64(1)))
            carry = ones & d
            ones ^= d
            over |= twos & carry
            twos ^= carry
            if bit % 8 == 7:
                beyond = (over | (twos & ones)) if radius == 2 else (over | twos) if radius == 1 else (over | twos | ones)
                live = (beyond & filled[at]) != filled[at]
                if not live.all():
                    rows, at, ones, twos, over, beyond = (x[live] for x in (rows, at, ones, twos, over, beyond))
        if rows.size:
            near = ~beyond & filled[at]
            lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, j = np.nonzero(lanes)
            x = rows[r]
            y = start[of[x]] + (at[r] - base[of[x]]) * 64 + j
            keep = x < y
            a, b = np.r_[a, x[keep]], np.r_[b, y[keep]]
            if a.size > n:
                root = local_roots(n, a, b)
                a = np.flatnonzero(root != np.arange(n))
                b = root[a]
        lo = hi
    root = local_roots(n, a, b)
    a = np.flatnonzero(root != np.arange(n))
    return a, root[a]


def _band_pairs(value, width: int, of: int = 4):
    """For each pair of the ``of`` bands of ``width`` bits: the pair's number, with both bands below."""
    band = [F.shiftrightunsigned(value, width * i).bitwiseAND((1 << width) - 1) for i in range(of)]
    return F.array(*[
        F.lit(k << (2 * width)) + F.shiftleft(band[i], width) + band[j] for k, (i, j) in enumerate(combinations(range(of), 2))
    ])


def _other_bits(fp, key):
    """The 32 bits of ``fp`` outside the two 16-bit bands of pair number ``key >> 32``."""
    out = F.lit(None).cast("long")
    for k, pair in enumerate(combinations(range(4), 2)):
        x, y = (i for i in range(4) if i not in pair)
        band = lambda i: F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        out = F.when(F.shiftrightunsigned(key, 32) == k, F.shiftleft(band(x), 16) + band(y)).otherwise(out)
    return out


def fingerprint_links(fps: DataFrame, radius: int = MOST_RADIUS, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: links that join all fingerprints of the column ``fp`` within ``radius`` bits.

    ``fp`` is unique in ``fps``. In each block there are fewer links than fingerprints, never all pairs.
    """
    keyed = fps.select("fp", F.explode(_band_pairs(F.col("fp"), 16)).alias("key"))
    hot = checkpointed(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", F.lit(True).alias("hot")))
    none, again = F.array(F.lit(-1).cast("long")), _band_pairs(_other_bits(F.col("fp"), F.col("key")), 8)
    blocks = keyed.join(small_or_shuffled(hot), "key", "left").select("fp", "key", F.explode(F.when(F.col("hot"), again).otherwise(none)).alias("sub"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, ["key", "sub"]):
            new = starts_of(rows, ["key", "sub"])
            run = np.cumsum(new) - 1
            alone = np.bincount(run)[run] == 1
            fp, run = rows["fp"].to_numpy()[~alone], run[~alone]
            if fp.size:
                a, b = sliced_links(fp.view(np.uint64), run, radius)
                yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return blocks.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = MOST_RADIUS, shingle: int = 3
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that the row reaches over links of at most ``radius`` bits,
    itself included; rows with one fingerprint are linked. A null id never names a component; a
    component of null ids alone has a null name. Repeated rows are returned as often as they occur.
    """
    each = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    # one row for each fingerprint: copies are never compared, nor expanded into pairs
    distinct = checkpointed(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = checkpointed(named.join(ids, "component").select("fp", "component_id"))
    return each.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Of the pipeline's stage: words in a shingle, similarity of sets of shingles, and differing bits that candidates have at most.
SHINGLE, SHARE, REACH = 5, 0.8, 20
#: Functions whose least hashes, two by two, are the blocks that texts are compared in.
MINIMA = 6
#: Up to this many candidates of a text are of one component each.
APART = 4
#: Blocks and families of more texts are dealt to parts, families of more shingles as well.
PART, SHINGLES = 2_048, 1 << 20
#: Shingles of candidates that are looked up at a time.
_LOOKED_UP = 1 << 19


def similar_links(
    texts: DataFrame, share: float = SHARE, shingle: int = SHINGLE, radius: int = REACH, part: int = PART,
    read: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``a``, ``b``: links that join all texts (``node``, unique; ``text``) whose sets of shingles resemble by ``share``.

    Texts with two least shingles of MINIMA functions in common share a block, which two texts that resemble by 0.8
    fail to with a chance of 0.0016. In a block, fingerprints are compared bit-sliced, and those within ``radius``
    bits are candidates; sets that resemble by 0.8 differ in 10 bits of 64 on average, and in over 20 once in
    thousands. What candidates join is a family. A family's texts are read once, in a task that compares their sets
    of shingles in full (:class:`Sets`), so neither candidates nor pairs of texts are ever rows: blocks and families
    alike give fewer links than they have texts. Texts without words have no links. ``read`` adds their texts to rows
    of few nodes, if there is a cheaper way than a join with ``texts``.
    """
    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps, keys, nodes, sizes = [], [], [], []
        for node, t in zip(batch["node"].to_pylist(), batch["text"], strict=True):
            h = _set_of(t.as_py(), shingle)
            if h.size:
                nodes.append(node)
                sizes.append(h.size)
                bits = np.unpackbits(_spread(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
                fps.append(np.packbits(2 * bits > h.size, bitorder="little").view(np.int64)[0])
                least = [int(_spread(h ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))).min()) for k in range(1, MINIMA + 1)]
                keys.append([xxhash.xxh3_64_intdigest(f"{i} {j} {least[i]} {least[j]}") - (1 << 63) for i, j in combinations(range(MINIMA), 2)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "fp", "size", "keys"]
        )

    made = checkpointed(by_batch(texts.select("node", "text"), make, "node long, fp long, size long, keys array<long>"))
    rows = made.select("node", "fp", F.explode("keys").alias("group"))
    shared = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = checkpointed(rows.join(shared.select("group"), "group").withColumn("size", F.lit(0).cast("long")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs_of(batches, ["group", "part"]):
            node, fp, component = (some[c].to_numpy() for c in ("node", "fp", "component"))
            a, b = near_links(fp.view(np.uint64), np.cumsum(starts_of(some, ["group", "part"])) - 1, component, radius)
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    def in_blocks(dealt: DataFrame, again: bool) -> DataFrame:
        return dealt.repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(near, "a long, b long")

    def in_families(dealt: DataFrame, again: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _resembling(batches, share, shingle, again)

        few = checkpointed(dealt)
        # six numbers a row
        found = read(few) if read else texts.select("node", "text").join(small_or_shuffled(few), "node")
        members = found.select("group", "part", "guest", "component", "node", "text")
        return members.repartition("group", "part").sortWithinPartitions("group", "part", "guest", "node").mapInArrow(run, "a long, b long")

    families = components(_linked_by_parts(blocks, in_blocks, part)).select("node", F.col("component").alias("group"))
    return _linked_by_parts(checkpointed(families.join(made.select("node", "size"), "node")), in_families, part)


def _linked_by_parts(rows: DataFrame, links_of: Callable[[DataFrame, bool], DataFrame], part: int) -> DataFrame:
    """``a``, ``b``: what ``links_of`` finds in the groups of ``rows`` (``group``, ``node``, ``size`` and others).

    Groups of more than ``part`` nodes, or of more than SHINGLES in size, are dealt to parts, whose links are found
    first. Then the nodes outside such a group's largest component visit all other parts as guests, so any two of
    different components meet. ``links_of`` gets ``part``, ``guest`` and ``component`` with the rows, and whether this
    is the second time, when only guests and their hosts are left to compare.
    """
    sizes = rows.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(part), F.sum("size") / F.lit(SHINGLES))).cast("long").alias("parts"))
    split = checkpointed(sizes.where("parts > 1"))
    if split.isEmpty():
        return checkpointed(links_of(rows.select("*", F.lit(0).cast("long").alias("part"), F.lit(False).alias("guest"), F.col("node").alias("component")), False))
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(small_or_shuffled(split), "group", "left").select(*rows.columns, own.alias("part"), F.lit(False).alias("guest"), F.col("node").alias("component"))
    links = checkpointed(links_of(dealt, False))
    joined = components(links).select("node", F.col("component").alias("c"))
    large = checkpointed(rows.join(small_or_shuffled(split), "group").join(joined, "node", "left").select(*rows.columns, "parts", F.coalesce("c", "node").alias("component")))
    largest = large.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(
        F.count(F.lit(1)).alias("components"), F.max(F.struct("n", "component"))["component"].alias("largest")
    )
    # groups of one component have nothing left to compare
    open_ = checkpointed(largest.where("components > 1").select("group", "largest"))
    to = F.when(F.col("component") == F.col("largest"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    visits = large.join(small_or_shuffled(open_), "group").select(*rows.columns, "component", own.alias("own"), F.explode(to).alias("part"))
    return links.unionByName(checkpointed(links_of(visits.withColumn("guest", F.col("part") != F.col("own")).drop("own"), True)))


def near_links(fp: np.ndarray, block: np.ndarray, component: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``a``, ``b`` that join, in each block, all fingerprints within ``radius`` bits that ``component`` does not join yet.

    Each row proposes the first of lower components; what was found joins components, until a block finds nothing.
    """
    component, live = np.unique(component, return_inverse=True)[1], np.arange(fp.size)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while live.size:
        live = live[np.lexsort((component[live], block[live]))]
        x, y = (live[at] for at in first_near(fp[live], block[live], live, component[live], {}, radius))
        component = local_roots(fp.size, component[x], component[y])[component]
        a, b = np.r_[a, x], np.r_[b, y]
        live = live[np.isin(block[live], block[x])]
    root = local_roots(fp.size, a, b)
    a = np.flatnonzero(root != np.arange(fp.size))
    return a, root[a]


class Sets:
    """Sets of hashes, among which those that resemble a set by ``share`` are found exactly.

    Hashes are ranked by how few sets have them. Two sets that resemble by ``share`` have one in common among the
    first ``size - ceil(share * size) + 1`` of either, which are mostly its own: only sets that are met there are
    compared, those with most in common first, and none that is joined already.
    """

    def __init__(self, nodes: list[int], names: list[int], sets: list[np.ndarray], share: float) -> None:
        self.nodes, self.share, self.size = nodes, share, np.array([s.size for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.hashes, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        self.rank = np.empty(count.size, np.int64)
        self.rank[np.argsort(count, kind="stable")] = np.arange(count.size)
        owner, token = np.repeat(np.arange(len(sets)), self.size), self.rank[at]
        order = np.lexsort((token, owner))
        self.token, self.first = token[order], np.cumsum(self.size) - self.size
        early = np.arange(flat.size) - self.first[owner] < self._early(self.size)[owner]
        met, who = self.token[early], owner[early]
        order = np.argsort(met, kind="stable")
        self.who, self.ends = who[order], np.r_[0, np.cumsum(np.bincount(met, minlength=count.size))]
        self.mark = np.zeros(count.size, bool)
        # components: a number for each set, the sets of each number, and numbers that have become others
        self.number: dict[int, int] = {}
        self.of = np.array([self.number.setdefault(c, len(self.number)) for c in names], np.int64)
        self.members: list[list[int]] = [[] for _ in self.number]
        for i, c in enumerate(self.of.tolist()):
            self.members[c].append(i)
        self.became = list(range(len(self.number)))

    def _early(self, size):
        return size - np.ceil(self.share * size - 1e-9).astype(np.int64) + 1

    def _now(self, c: int) -> int:
        while self.became[c] != c:
            c = self.became[c]
        return c

    def inside(self) -> Iterator[tuple[int, int]]:
        """Links that join all of the sets that resemble."""
        for i in range(1, len(self.nodes)):
            tokens = self.token[self.first[i] : self.first[i] + self.size[i]]
            for j in self._near(tokens, int(self.size[i]), int(self.of[i]), i):
                yield self.nodes[i], self.nodes[j]

    def of_guest(self, node: int, name: int, own: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links from another set, of the component ``name``, to each component of which it resembles a set."""
        at = np.searchsorted(self.hashes, own)
        at[at == self.hashes.size] = 0
        known = self.hashes[at] == own if self.hashes.size else np.zeros(own.size, bool)
        # hashes that no set has are its first
        tokens = np.r_[np.full(own.size - int(known.sum()), -1), np.sort(self.rank[at[known]])]
        if name not in self.number:
            self.number[name] = len(self.became)
            self.became.append(len(self.became))
            self.members.append([])
        for j in self._near(tokens, own.size, self._now(self.number[name]), None):
            yield node, self.nodes[j]

    def _near(self, tokens: np.ndarray, size: int, component: int, below: int | None) -> Iterator[int]:
        early = tokens[: int(self._early(np.int64(size)))]
        early = early[early >= 0]
        lo, hi = self.ends[early], self.ends[early + 1]
        some = hi - lo > (below is not None)
        met = [self.who[i:j] for i, j in zip(lo[some].tolist(), hi[some].tolist(), strict=True)]
        if not met:
            return
        found = np.concatenate(met)
        ok = self.of[found] != component
        if below is not None:
            ok &= found < below
        found, hits = np.unique(found[ok], return_counts=True)
        least = np.minimum(self.size[found], size) >= self.share * np.maximum(self.size[found], size) - 1e-9
        found = found[least][np.argsort(-hits[least], kind="stable")]
        tokens, most = tokens[tokens >= 0], 4
        self.mark[tokens] = True
        while found.size:
            sizes = self.size[found[:most]]
            n = max(1, int(np.searchsorted(np.cumsum(sizes), _LOOKED_UP, "right")))
            now, found, sizes = found[: min(n, most)], found[min(n, most) :], sizes[:n]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self.first[now] - (ends - sizes), sizes)
            common = np.add.reduceat(self.mark[self.token[at]], ends - sizes, dtype=np.int64)
            for j in now[common >= self.share * (sizes + size - common) - 1e-9].tolist():
                if self.of[j] != component:
                    component = self._join(component, int(self.of[j]))
                    yield j
            found = found[self.of[found] != component]
            most *= 4
        self.mark[tokens] = False

    def _join(self, a: int, b: int) -> int:
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b], self.became[b] = [], a
        return a


def _resembling(batches: Iterator[pa.RecordBatch], share: float, shingle: int, again: bool) -> Iterator[pa.RecordBatch]:
    """Links of families' parts, sorted so that guests follow their hosts: they are compared one by one, and not kept."""
    key, nodes, names, sets, hosts = None, [], [], [], None

    def hosted() -> tuple[Sets, list[tuple[int, int]]]:
        made = Sets(nodes, names, sets, share)
        return made, [] if again else list(made.inside())

    def sent(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    for batch in batches:
        links = []
        for group, part, guest, name, node, text in zip(*(batch[c].to_pylist() for c in ("group", "part", "guest", "component", "node")), batch["text"], strict=True):
            if (group, part) != key:
                if hosts is None and not again:
                    links += hosted()[1]
                key, nodes, names, sets, hosts = (group, part), [], [], [], None
            if not guest:
                nodes.append(node)
                names.append(name)
                sets.append(_set_of(text.as_py(), shingle))
                continue
            if hosts is None:
                hosts, more = hosted()
                links += more
            links += hosts.of_guest(node, name, _set_of(text.as_py(), shingle))
        if links:
            yield sent(links)
    if hosts is None and not again and (links := hosted()[1]):
        yield sent(links)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _set_of(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of the distinct shingles of a text; the whole sequence where it has fewer words."""
    w = split_words(text)
    if not w:
        return np.zeros(0, np.uint64)
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))[at]
    size = min(shingle, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = _spread(h + word[k : k + h.size])
    return np.unique(h)


def first_near(fp: np.ndarray, block: np.ndarray, node: np.ndarray, component: np.ndarray, refuted: dict[int, list[int]], radius: int, most: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``a`` and, for each, the first rows ``b`` of lower components of its block within ``radius`` bits, ``most`` at most.

    Up to APART of them are of one component each; a ``most`` beyond that takes any, as texts of two components that
    stay apart all have to be compared. ``block`` is sorted and, inside it, ``component``. A row meets the words of 64
    rows of its block from the first on, until it has found as many. ``refuted`` names, by row, nodes that it may not propose.
    """
    n = fp.size
    planes, filled, base, of, start = _sliced(fp, block)
    # rows of lower components are those before the component's first
    own = np.r_[True, (block[1:] != block[:-1]) | (component[1:] != component[:-1])][:n]
    end = np.flatnonzero(own)[np.cumsum(own) - 1] if n else np.zeros(0, np.int64)
    found, latest, step = np.zeros(n, np.int64), np.full(n, -1), 0
    live = np.flatnonzero(end > start[of]) if n else np.zeros(0, np.int64)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while live.size:
        for lo in range(0, live.size, _AT_ONCE):
            some = live[lo : lo + _AT_ONCE]
            at = base[of[some]] + step
            near = _within(planes, fp[some], at, radius) & filled[at]
            lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, j = np.nonzero(lanes)
            row = some[r]
            other = start[of[row]] + step * 64 + j
            ok = other < end[row]
            if refuted:
                ok &= np.array([r not in refuted or node[o] not in refuted[r] for r, o in zip(row.tolist(), other.tolist(), strict=True)], bool)
            row, other = row[ok], other[ok]
            if most <= APART:
                # the first of each component, which is not the last one that was found
                new = np.r_[True, (row[1:] != row[:-1]) | (component[other[1:]] != component[other[:-1]])][: row.size]
                new &= component[other] != latest[row]
                row, other = row[new], other[new]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: row.size])
            rank = np.arange(row.size) - np.repeat(first, np.diff(np.r_[first, row.size])) + found[row]
            row, other = row[rank < most], other[rank < most]
            np.add.at(found, row, 1)
            latest[row] = component[other]
            a.append(row)
            b.append(other)
        step += 1
        live = live[(found[live] < most) & (start[of[live]] + step * 64 < end[live])]
    return np.concatenate(a), np.concatenate(b)


def _within(planes: np.ndarray, fp: np.ndarray, at: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint and word ``at`` of 64 others, the lanes that differ in at most ``radius`` bits.

    Counters begin so high that they overflow beyond the radius; words all of whose lanes have are abandoned.
    """
    width = radius.bit_length()
    begin, out, rows = (1 << width) - 1 - radius, np.zeros(fp.size, np.uint64), np.arange(fp.size)
    counters = [np.full(fp.size, _BELOW if begin >> i & 1 else 0, np.uint64) for i in range(width)]
    over = np.zeros(fp.size, np.uint64)
    for bit in range(64):
        carry = planes[bit, at] ^ (np.uint64(0) - ((fp >> np.uint64(bit)) & np.uint64(1)))
        for i in range(width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if bit % 8 == 7 and bit > radius:
            live = over != _BELOW
            if not live.all():
                rows, fp, at, over, *counters = (x[live] for x in (rows, fp, at, over, *counters))
    out[rows] = ~over
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, shingle: int = SHINGLE, radius: int = REACH) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near-duplicates.

    Texts are near-duplicates if their sets of shingles (words in lower case) resemble by ``share``, and a group is
    what links join (:func:`similar_links`). Of a group the row with the smallest id stays, of several with that id
    the one with the least text hash, and of rows that repeat id and text one. Rows without an id stay only where no
    row of their group has one, and then one of them. Texts without words, null ones too, are one group. Rows that
    share an id but no group are told apart by their texts.
    """
    blank = F.lit(r"[^\x20\x09-\x0D]")
    rows = need(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text")).select("id", "text", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"))
    each = checkpointed(rows.groupBy("id", "x", "y").agg(F.count(F.lit(1)).alias("rows"), F.max(F.regexp_like("text", blank)).alias("words")))
    # a number for each text; copies are never compared
    node = checkpointed(each.groupBy("x", "y").agg(F.min("id").alias("least"), F.max("words").alias("words")).withColumn("node", F.monotonically_increasing_id()))
    one = checkpointed(each.join(node.where("words").select("x", "y", "node", "least"), ["x", "y"]).where("id <=> least").select("id", "x", "y", "node", "rows"))

    def chosen(some: DataFrame, *more: str) -> DataFrame:
        some = small_or_shuffled(some.select(F.col("id").alias("i"), F.col("x").alias("p"), F.col("y").alias("q"), "node", *more))
        return rows.join(some, F.col("id").eqNullSafe(F.col("i")) & (F.col("x") == F.col("p")) & (F.col("y") == F.col("q"))).select("node", "text", *more)

    repeats = not one.where("rows > 1").isEmpty()

    def texts_of(some: DataFrame, *more: str) -> DataFrame:
        found = chosen(some.where("rows = 1"), *more)
        return found.unionByName(chosen(some.where("rows > 1"), *more).dropDuplicates(["node", *more])) if repeats else found

    def read(few: DataFrame) -> DataFrame:
        # few rows find their texts, so that not all texts are shuffled
        return texts_of(checkpointed(one.join(few, "node")), *[c for c in few.columns if c != "node"])

    joined = components(similar_links(texts_of(one), share, shingle, radius, read=read)).select("node", "component")
    group = node.join(joined, "node", "left").select("x", "y", F.when(F.col("words"), F.coalesce("component", "node")).otherwise(F.lit(-1)).alias("group"))
    ranked = each.join(group, ["x", "y"]).select("group", "rows", F.struct(F.col("id").isNull().alias("none"), "id", "x", "y").alias("row"))
    best = ranked.groupBy("group").agg(F.min("row").alias("best"))
    # the winners of groups of several are told from the others by rank, not by a join on ids that may be null
    split = checkpointed(ranked.join(best, "group").select("rows", F.expr("row <=> best").alias("stays"), F.col("row.id").alias("__id"), F.col("row.x").alias("__x"), F.col("row.y").alias("__y")))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    here = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__x")) & (F.xxhash64(F.lit(1), text) == F.col("__y"))
    kept = docs.join(small_or_shuffled(split.where("NOT stays")), here, "left_anti")
    again = checkpointed(split.where("stays AND rows > 1"))
    if again.isEmpty():
        return kept
    again = small_or_shuffled(again)
    repeated = kept.join(again, here, "left_semi").withColumn("__text", text).dropDuplicates([id_col, "__text"]).drop("__text")
    return kept.join(again, here, "left_anti").unionByName(repeated)
