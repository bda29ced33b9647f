"""Rows that share an id, near copies against brute force, and recall of edited passages."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from sievework.llm import decontaminate, passages, simhash
from sievework.llm.common import local_roots

DOCS = "doc_id long, text string"
WORDS = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "gle", "mir", "no", "pra", "sta", "vol") for b in ("l", "ne", "rt", "sum", "ta", "x", "wo", "ki")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# --- rows that share an id, or have none ----------------------------------------------------------------


def test_a_leak_takes_its_own_row_alone(spark):
    item = prose(30, 1)
    rows = [(1, f"{prose(20, 2)} {item}"), (1, prose(40, 3)), (None, item), (None, prose(30, 4)), (2, None), (2, item)]
    left = decontaminate.clean(frame(spark, rows), frame(spark, [(7, item)], "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == sorted((str(d), t or "") for d, t in rows if item not in (t or ""))


def test_near_copies_leave_unrelated_rows_of_their_id(spark):
    a, b = prose(200, 10), prose(200, 11)
    left = lambda rows: sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in simhash.one_of_each(frame(spark, rows)).collect())
    assert left([(4, a), (9, a), (9, b)]) == sorted([(4, a), (9, b)])
    assert left([(7, a), (7, b)]) == sorted([(7, a), (7, b)])
    assert left([(1, a), (None, a), (None, b), (None, b)]) == sorted([(1, a), (-1, b)])
    assert left([(3, a), (3, a), (3, b)]) == sorted([(3, a), (3, b)])
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def test_passages_are_cut_from_their_own_row_alone(spark):
    shared = prose(70, 20)
    t0, t1, t2 = f"{prose(40, 21)} {shared}", f"{prose(40, 22)} {shared} {prose(30, 23)}", prose(120, 24)
    got = passages.deduplicated(frame(spark, [(1, t0), (2, t1), (2, t2), (None, t1), (None, t2)])).collect()
    kept = sorted(r.text for r in got)
    assert len(kept) == 5 and kept.count(t2) == 2 and kept.count(t0) == 1
    one = [r.text for r in got if r.doc_id == 2 and r.text != t2]
    assert len(one) == 1 and shared not in one[0] and prose(30, 23)[-60:] in one[0]


# --- near copies ----------------------------------------------------------------------------------------


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_groups(rows, share=0.8):
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])]
    return local_roots(len(rows), *(np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ()))))


@pytest.mark.parametrize("part", [8])
def test_one_of_each_group_of_near_copies_stays(spark, part):
    r, rows = random.Random(3), []
    for g in range(12):
        base = prose(r.randint(30, 160), 100 + g).split()
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4, 8])):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1, 1])] = [r.choice(WORDS)]
            rows.append((r.randint(0, 10**6), " ".join(w)))
    rows += [(10**6 + 1, "one two"), (10**6 + 2, "One TWO"), (10**6 + 3, "one"), (10**6 + 4, ""), (10**6 + 5, None)]
    root = brute_groups(rows)
    ids = np.array([d for d, _ in rows])
    want = {min(ids[root == g]) for g in set(root.tolist())}
    texts = spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(rows) if t], "node long, text string")
    links = simhash.similar_links(texts, part=part).collect()
    got = local_roots(len(rows), np.array([x.a for x in links], np.int64), np.array([x.b for x in links], np.int64))
    assert np.array_equal(got[: len(rows) - 2], root[: len(rows) - 2])
    assert {x.doc_id for x in simhash.one_of_each(frame(spark, rows)).collect()} == want


def loose_copies(n):
    """Copies of one text with two other words each: most resemble by 0.5, those of the last tenth by 0.8 or more."""
    r, base = random.Random(11), prose(60, 9100).split()
    out = []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(60), 2) if i < 0.9 * n else [0]:
            w[at] = f"other{r.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_loose_copies_take_room_as_texts_not_as_pairs(spark):
    texts = loose_copies(400)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    used = lambda: sum(f.stat().st_size for f in Path(shared).rglob("*") if f.is_file())
    before = used()
    got = simhash.similar_links(spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()
    assert used() - before < 12 * sum(map(len, texts))
    root = local_roots(400, np.array([x.a for x in got], np.int64), np.array([x.b for x in got], np.int64))
    want = brute_groups(list(enumerate(texts)))
    assert len(got) < 400 and np.array_equal(root, want)


def test_near_links_join_what_pairs_join():
    r = np.random.default_rng(5)
    fp = np.repeat(r.integers(0, 1 << 63, 60, dtype=np.uint64), 5)
    for _ in range(6):
        fp ^= np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)
    block, component = np.sort(r.integers(0, 4, 300)), np.r_[np.zeros(20, np.int64), np.arange(20, 300)]
    pairs = [(i, j) for i in range(300) for j in range(i) if block[i] == block[j] and int(fp[i] ^ fp[j]).bit_count() <= 10]
    same = [(i, 0) for i in range(20)]
    root = lambda links: local_roots(300, *(np.array(x, np.int64) for x in zip(*links)))
    a, b = simhash.near_links(fp, block, component, 10)
    assert a.size < 300 and np.array_equal(root([*zip(a.tolist(), b.tolist()), *same]), root([*pairs, *same]))


def test_sets_join_what_brute_force_joins():
    r = random.Random(8)
    base = [r.sample(range(10**6), 40) for _ in range(6)]
    sets = [np.unique(np.array([r.randrange(10**6) if r.random() < 0.06 else x for x in r.choice(base)] + list(range(20)), np.uint64)) for _ in range(120)]
    like = lambda x, y: len(set(x.tolist()) & set(y.tolist())) >= 0.8 * len(set(x.tolist()) | set(y.tolist()))
    pairs = [(i, j) for i in range(120) for j in range(i) if like(sets[i], sets[j]) and (i < 80 or j < 80)]
    roots = lambda links: local_roots(120, *(np.array(x, np.int64) for x in zip(*links)))
    hosts = simhash.Sets(list(range(80)), list(range(80)), sets[:80], 0.8)
    inside = list(hosts.inside())
    links = inside + [x for i in range(80, 120) for x in hosts.of_guest(i, i, sets[i])]
    # each link joins two components, so there are no more than make a forest
    assert len(links) == 120 - len(set(roots(pairs).tolist())) and np.array_equal(roots(links), roots(pairs))
    assert all(like(sets[i], sets[j]) for i, j in links) and not list(simhash.Sets([], [], [], 0.8).of_guest(1, 1, sets[0]))


@pytest.mark.parametrize("radius", [1, 5, 20])
def test_sliced_counters_are_distances(radius):
    r = np.random.default_rng(radius)
    fp = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp[150:] = fp[:150] ^ (np.uint64(1) << r.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 150, dtype=np.uint64))
    block, component, node = np.sort(r.integers(0, 2, 300)), np.arange(300), np.arange(300)
    a, b = simhash.first_near(fp, block, node, component, {299: [int(x) for x in range(0, 300, 2)]}, radius)
    want = {}
    for i in range(300):
        near = [j for j in range(i) if block[i] == block[j] and int(fp[i] ^ fp[j]).bit_count() <= radius and not (i == 299 and j % 2 == 0)]
        if near:
            want[i] = near[0]
    assert dict(zip(a.tolist(), b.tolist())) == want
    a, b = simhash.first_near(fp, block, node, component, {}, radius, most=3)
    for i in range(300):
        near = [j for j in range(i) if block[i] == block[j] and int(fp[i] ^ fp[j]).bit_count() <= radius]
        assert b[a == i].tolist() == near[:3]


def test_later_rounds_take_several_texts_of_a_component():
    n = 200
    fp, block = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    component, node = np.where(np.arange(n) < n - 2, 0, np.arange(n)), np.arange(n)
    refuted = {n - 1: list(range(10))}
    a, b = simhash.first_near(fp, block, node, component, refuted, 20, most=1)
    assert sorted(zip(a.tolist(), b.tolist())) == [(n - 2, 0), (n - 1, 10)]
    # one of a component at a time would take as many rounds as it has texts
    a, b = simhash.first_near(fp, block, node, component, refuted, 20, most=64)
    assert b[a == n - 1].tolist() == list(range(10, 74)) and b[a == n - 2].tolist() == list(range(64))


# --- passages -------------------------------------------------------------------------------------------


def resembling(x, y, least=50):
    """Whether some aligned stretch of at least ``least`` words resembles by 0.8, by trying all stretches of ``x``."""
    a, b = [tuple(x[i : i + 5]) for i in range(len(x) - 4)], [tuple(y[i : i + 5]) for i in range(len(y) - 4)]
    place = {s: j for j, s in enumerate(b)}
    common = [(i, place[s]) for i, s in enumerate(a) if s in place]
    for p in range(len(common)):
        for q in range(len(common) - 1, p, -1):
            (i, k), (j, m) = common[p], common[q]
            if j - i + 5 < least:
                break
            s, t = set(a[i : j + 1]), set(b[k : m + 1])
            if len(s & t) >= 0.8 * len(s | t):
                return True
    return False


def test_recall_of_edited_passages(spark):
    r, rows, want, cells = random.Random(17), [], set(), {}
    for d in range(360):
        n, edits = (60, 80, 120)[d % 3], 1 + d // 3 % 4
        copy = [f"p{d}x{k}" for k in range(n)]
        other = list(copy)
        for at in r.sample(range(n), edits):
            other[at] = f"new{d}x{at}"
        for i, w in ((d, copy), (d + 1000, other)):
            rows.append((i, " ".join([*(f"a{i}x{k}" for k in range(30)), *w, *(f"b{i}x{k}" for k in range(30))])))
        if resembling(other, copy):
            want.add(d + 1000)
            cells.setdefault((n, edits), set()).add(d + 1000)
    got = {x.doc_id for x in passages.passages(frame(spark, rows)).where("NOT is_first").collect()}
    assert len(got & want) >= 0.97 * len(want) and len(want) > 250
    assert {c: len(got & w) / len(w) for c, w in cells.items() if len(got & w) < 0.9 * len(w)} == {}
    assert not {d for d in got if d not in want and d < 1000}


def test_stretches_are_the_longest_that_resemble():
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(46, 200))
        x = np.arange(n, dtype=np.uint64)
        y = x.copy()
        for at in r.integers(0, n, int(r.integers(0, 6))):
            y[max(0, at - 4) : at + 1] += np.uint64(10_000)
        part, there = passages._common(x, y, 0)
        best = 0
        for i in range(part.size):
            for j in range(part.size - 1, i - 1, -1):
                if part[j] - part[i] + 5 < 50 or part[j] - part[i] < best:
                    break
                if passages._resemble(x[part[i] : part[j] + 1], y[there[i] : there[j] + 1], 0.8):
                    best = int(part[j] - part[i])
        got = max((b - a for a, b, _, _ in passages.aligned(x, y, [(0, n - 1, 0, n - 1)], 50, 0.8)), default=0)
        assert got == best


def test_windows_of_repeated_words_are_few_and_quick(spark):
    rows = [(1, "la " * 60_000), (2, prose(60, 1) + " la" * 300), (3, prose(55, 2) + " la" * 500)]
    assert passages.windows(frame(spark, rows).withColumnRenamed("doc_id", "doc")).where("doc = 1").count() < 50
    got = {x.doc_id for x in passages.passages(frame(spark, rows)).collect()}
    assert got == {1, 2, 3}
