"""The text-preparation operators on small cases and against brute force."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import (
    chat, decontaminate, fingerprint, lengthpack, passages, quality, recurrent, simhash, tokenpack, toxicity,
)
from sievework.llm.common import components, local_roots, trained_in_task, training_rows

DOCS = "doc_id long, text string"
rng = random.Random(5)
WORDS = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "gle", "mir", "no", "pra") for b in ("l", "ne", "rt", "sum", "ta", "x", "wo")]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (None, "one two three four five six"), (5, "ONE"), (5, "ONE")]


# --- what operators share ---------------------------------------------------------------------------


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 130)] + [(7, 8), (8, 9), (9, 7), (5, 5)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(frame(spark, links, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 130)}, 7: 7, 8: 7, 9: 7}
    assert components(frame(spark, [], "a long, b long")).count() == 0


@pytest.mark.parametrize("local", [0, 60, 1_000_000])
def test_few_links_are_joined_in_a_few_jobs(spark, local):
    links = [(i, i + 1) for i in range(-40, 40)] + [(100, i) for i in range(101, 130)] + [(None, 5), (1 << 62, -(1 << 62))]
    want = {**{i: -40 for i in range(-40, 41)}, **{i: 100 for i in range(100, 130)}, 1 << 62: -(1 << 62), -(1 << 62): -(1 << 62)}
    edges = frame(spark, links, "a long, b long")
    spark.sparkContext.setJobGroup(f"few {local}", "links")
    got = components(edges) if local > 100 else components(edges, local=local)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few {local}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.component for r in got.collect()} == want
    assert jobs <= 8 or local < 100


def test_local_roots_reach_the_smallest_node():
    n, a, b = 50, np.array([3, 9, 20, 21, 4]), np.array([9, 20, 21, 3, 5])
    root = local_roots(n, a, b)
    assert set(root[[3, 9, 20, 21]]) == {3} and set(root[[4, 5]]) == {4} and root[7] == 7


@pytest.mark.parametrize("longest", range(6))
def test_a_text_beyond_the_bound_leaves_the_others_in_the_sample(spark, longest):
    rows = [(d, "x" * (500 if d == longest else 10)) for d in range(6)]
    labels = frame(spark, [(d, d % 2) for d in range(6)], "doc_id long, label int")
    texts, y = training_rows(frame(spark, rows), labels, F.lit(True), "label", most_chars=60)
    assert texts == ["x" * 10] * 5 and sorted(y.tolist()) == sorted(d % 2 for d in range(6) if d != longest)
    alone, one = training_rows(frame(spark, rows[longest : longest + 1]), labels, F.lit(True), "label", most_chars=60)
    assert alone == ["x" * 500] and one.tolist() == [longest % 2]


# --- 1 ----------------------------------------------------------------------------------------------


def brute_leaks(docs, items, share=0.8):
    out = set()
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if not v:
                continue
            k = min(5, len(v))
            q = {" ".join(v[j : j + k]) for j in range(len(v) - k + 1)}
            have = {" ".join(w[j : j + k]) for j in range(len(w) - k + 1)}
            if len(q & have) >= -(-round(len(q) * share * 1000) // 1000):
                out.add((d, i, len(q), len(q & have)))
    return out


def test_leaks_are_those_of_brute_force(spark):
    items = [(i, prose(rng.randint(1, 60), 1000 + i)) for i in range(25)] + [(90, None), (91, ""), (92, "ba.")]
    docs = []
    for d in range(60):
        w = prose(rng.randint(0, 300), d).split()
        if d % 3 == 0:
            item = items[d % 25][1].split()
            if d % 2 and len(item) > 20:
                item[10] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = item
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (None, items[7][1]), (202, items[8][1].upper())]
    found = decontaminate.leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in found}
    assert got == brute_leaks(docs, items) and any(r.containment < 1 for r in found)


def test_clean_keeps_rows_and_clashing_columns(spark):
    docs = frame(spark, [(1, "a b c d e f", 7), (2, "x y", 8), (None, None, 9)], "doc_id long, text string, item long")
    left = decontaminate.clean(docs, frame(spark, [(1, "B c D e f")], "item_id long, text string"))
    assert left.columns == docs.columns and {r.item for r in left.collect()} == {8, 9}
    empty = decontaminate.clean(docs, frame(spark, [], "item_id long, text string"))
    assert empty.count() == 3


# --- 2 ----------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_are_those_of_brute_force():
    texts = [None, "", " \t", "One", "one TWO", "É é A", *(prose(n, n) for n in (3, 4, 50, 500))]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_sliced_links_join_what_pairs_join(radius):
    r = np.random.default_rng(radius)
    seeds = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([seeds, *(s ^ (np.uint64(1) << r.integers(0, 64, 6, dtype=np.uint64)) for s in seeds), seeds[:20] ^ np.uint64(0b111)]))
    block = np.sort(r.integers(0, 3, fp.size))
    a, b = simhash.sliced_links(fp, block, radius)
    pairs = [(i, j) for i in range(fp.size) for j in range(i) if block[i] == block[j] and int(fp[i] ^ fp[j]).bit_count() <= radius]
    want = local_roots(fp.size, *(np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ()))))
    assert np.array_equal(local_roots(fp.size, a, b), want) and len(a) < fp.size


def test_frequent_blocks_lose_no_link(spark):
    r = np.random.default_rng(1)
    base = int(r.integers(0, 1 << 62))
    fps = {base}
    for _ in range(400):  # a dense cluster that shares most bands
        fps.add(base ^ (1 << int(r.integers(0, 64))) ^ (1 << int(r.integers(0, 64))))
    fps |= {int(x) for x in r.integers(0, 1 << 62, 200)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in sorted(fps)]
    order = {x: i for i, (x,) in enumerate(signed)}
    links = simhash.fingerprint_links(frame(spark, signed, "fp long"), block=16).collect()
    got = local_roots(len(signed), np.array([order[x.a] for x in links]), np.array([order[x.b] for x in links]))
    f = np.array([x for (x,) in signed], np.int64).view(np.uint64)
    pairs = [(i, j) for i in range(f.size) for j in range(i) if int(f[i] ^ f[j]).bit_count() <= 2]
    assert np.array_equal(got, local_roots(f.size, *(np.array(x) for x in zip(*pairs))))


def test_near_duplicates_name_the_smallest_id(spark):
    text = prose(400, 1)
    rows = [(9, text), (4, text.upper()), (7, prose(300, 2)), (1, None), (3, " "), (8, ""), (None, prose(300, 2)), (7, prose(300, 2))]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(9, 4), (4, 4), (7, 7), (7, 7), (None, 7), (1, 1), (3, 1), (8, 1)])
    assert {r.fingerprint for r in got if r.component_id == 1} == {"0" * 16}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    left = simhash.one_of_each(frame(spark, [(*r, 1) for r in rows], DOCS + ", component_id int"))
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 7] and "component_id" in left.columns


# --- 3 ----------------------------------------------------------------------------------------------


def test_equal_substrings_have_equal_interior_names():
    common = prose(200, 3)
    a, b = (set(fingerprint.parsed(x + " " + common + " " + y, 2)[-1].tolist()) for x, y in ((prose(40, 4), prose(9, 5)), (prose(77, 6), "")))
    whole = fingerprint.parsed(common, 2)[-1]
    assert len(set(whole.tolist()) & a & b) >= 0.9 * len(set(whole.tolist()))


def test_coin_tossing_separates_neighbours():
    x = fingerprint._mixed(np.arange(5000, dtype=np.uint64) % np.uint64(7))
    names = fingerprint._tossed(x)
    assert names.max() < 6 and (names[1:] != names[:-1]).all()


def test_likeness_of_texts():
    a, b = fingerprint.fingerprint(prose(300, 1)), fingerprint.fingerprint(prose(300, 2))
    assert fingerprint.likeness(a, a) == 1 == fingerprint.likeness("", "") and fingerprint.likeness(a, "") == 0
    assert fingerprint.likeness(a, b) < 0.3
    for t in ("", "a", "aaaa", "ab" * 5000, "x" * 100_000, None):
        assert fingerprint.fingerprint(t) == fingerprint.fingerprint(t)


def test_next_document_is_that_with_the_next_smaller_id(spark):
    rows = [(i * 3, prose(rng.randint(0, 60), i)) for i in range(40)] + [(500, None), (501, ""), (502, "ab"), (None, "the null id")]
    got = {r.doc_id: r for r in fingerprint.edit_robustness(frame(spark, rows), parts=7).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [rows[-1]]
    for (d, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 3
        want = (text[: len(text) - k] + after[:k]).encode()
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(want).hexdigest()
        assert got[d].near_next == fingerprint.likeness(fingerprint.fingerprint(text), fingerprint.fingerprint(after))
    assert len(got) == len(rows)
    assert fingerprint.edit_robustness(frame(spark, [])).count() == 0
    assert fingerprint.edit_robustness(frame(spark, [(1, "abcdef")])).collect()[0].near_next == 1
    twice = fingerprint.edit_robustness(frame(spark, [(1, "abc"), (1, "abc"), (2, "xyz")])).collect()
    assert sorted(r.doc_id for r in twice) == [1, 1, 2]


# --- 4 ----------------------------------------------------------------------------------------------


def test_best_fit_takes_the_least_room():
    for seed in range(20):
        r = np.random.default_rng(seed)
        lengths = r.integers(1, 65, 200)
        rooms, want = [], []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [x for x in rooms if x >= lengths[i]]
            if fits:
                rooms[rooms.index(min(fits))] -= lengths[i]
            else:
                rooms.append(64 - lengths[i])
        got = tokenpack.best_fit(lengths, 64)
        assert sorted(x for row in got for x in row) == list(range(200))
        want = sorted(rooms)
        assert sorted(64 - sum(int(lengths[i]) for i in row) for row in got) == want


def test_packed_rows_hold_every_token(spark, tmp_path):
    rows = [*ODD, (20, prose(900, 1)), (21, "naïve — 東京 🙂\r\n\t" * 30), (22, "<|endoftext|> x"), (23, "q" * 500)]
    docs = frame(spark, [(*r, 1) for r in rows if r[0] != 5], DOCS + ", row int")
    packed = tokenpack.packed(docs, width=64, pool=500)
    bpe, found = tokenpack.tokenizer(tokenpack.read_ranks()), defaultdict(dict)
    for r in packed.collect():
        ids, places, ends = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2"), r.cu_seqlens
        assert ids.size == places.size == 64 and ends[-1] == r.n_tokens and (ids[r.n_tokens :] == 50_256).all()
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            assert places[a:b].tolist() == list(range(b - a))
            found[r.doc_ids[k]][r.segments[k]] = ids[a:b]
    texts = {d: bpe.decode(np.concatenate([x[k] for k in sorted(x)]).tolist()) for d, x in found.items()}
    assert texts == {d: t for d, t in rows if t and d != 5}
    assert tokenpack.packed(frame(spark, [])).count() == 0
    tokenpack.write_matrices(packed, str(tmp_path / "m"))
    whole = spark.read.parquet(str(tmp_path / "m")).collect()
    assert sum(r.n_rows for r in whole) == packed.count() and all(len(r.ids) == r.n_rows * 128 for r in whole)


def test_long_texts_are_tokenised_as_a_whole():
    bpe, text = tokenpack.tokenizer(tokenpack.read_ranks()), prose(3000, 8) + "\n\n  " + prose(3000, 9)
    parts = list(tokenpack.parts_of(text, 700))
    assert "".join(parts) == text and len(parts) > 10
    assert sum((bpe.encode_ordinary(p) for p in parts), []) == bpe.encode_ordinary(text)
    assert "".join(tokenpack.parts_of("z" * 5000, 700)) == "z" * 5000


# --- 5 ----------------------------------------------------------------------------------------------


def test_each_long_stretch_is_in_one_window():
    h = np.random.default_rng(2).integers(0, 60, 150).astype(np.uint64)
    found = passages.compact_windows(h, 20)
    for i in range(150):
        for j in range(i + 19, 150):
            c = i + int(h[i : j + 1].argmin())
            assert [w for w in found if w[0] <= i <= w[1] <= j <= w[2]] == [w for w in found if w[1] == c and w[0] <= i and j <= w[2]]
            assert sum(w[0] <= i <= w[1] <= j <= w[2] for w in found) == 1


def test_repeated_passages_are_found_and_cut(spark):
    shared, other = prose(70, 50), prose(60, 51)
    near = shared.split()
    near[35] = "changed"
    rows = [(d, prose(120, 60 + d)) for d in range(30)]
    place = {}
    for d, passage in ((3, shared), (8, shared.upper()), (12, other), (20, " ".join(near)), (25, other), (27, shared + " " + other)):
        w = rows[d][1].split()
        rows[d] = (d, " ".join(w[:40]) + " " + passage + " " + " ".join(w[40:]))
        place[d] = (len(" ".join(w[:40])) + 1, passage)
    rows += [(40, rows[5][1]), (41, None), (42, ""), (43, "short"), (44, "short"), (None, shared)]
    got = defaultdict(list)
    for r in passages.passages(frame(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert set(got) == {3, 8, 12, 20, 25, 27, 5, 40}
    for d in (8, 20, 25, 27):
        begin, passage = place[d]
        spans = [(r.begin, r.end) for r in got[d] if not r.is_first]
        assert min(a for a, _ in spans) <= begin + 1 and max(b for _, b in spans) >= begin + len(passage) - 1
    assert [(r.begin, r.end) for r in got[40]] == [(0, len(rows[5][1]))]
    left = {r.doc_id: r for r in passages.deduplicated(frame(spark, [(*r, len(r[1] or ""), 1) for r in rows], DOCS + ", n_chars long, span int")).collect()}
    for d, text in rows:
        if d in (8, 20, 25, 27, 40):
            assert len(left[d].text) < len(text) and left[d].n_chars == len(left[d].text)
        else:
            assert left[d].text == text
    assert passages.passages(frame(spark, [])).count() == 0 == passages.deduplicated(frame(spark, [], DOCS)).count()


def test_frequent_passages_are_found_in_salted_parts(spark, monkeypatch):
    monkeypatch.setattr(passages, "SAMPLE", 1)
    monkeypatch.setattr(passages, "OFTEN", 5)
    shared = prose(60, 90)
    rows = [(d, prose(60, 100 + d) + " " + (shared if d % 2 else "") + " " + prose(30, 300 + d)) for d in range(80)]
    got = passages.passages(frame(spark, rows)).where("NOT is_first").select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == {d for d in range(80) if d % 2} - {1}


@pytest.mark.parametrize("part", [10**6, 10])
def test_edited_copies_are_found_where_the_smallest_document_is_edited_too(spark, monkeypatch, part):
    monkeypatch.setattr(passages, "SAMPLE", 1)
    monkeypatch.setattr(passages, "PART", part, raising=False)
    r, shared, rows = random.Random(8), [f"w{k}" for k in range(55)], []
    edited = {d: r.randrange(8, 47) if d % 8 else None for d in range(1, 41)}
    for d, at in edited.items():
        copy = [*shared[:at], f"edit{d}", *shared[at + 1 :]] if at else shared
        rows.append((d, " ".join([*(f"a{d}x{k}" for k in range(30)), *copy, *(f"b{d}x{k}" for k in range(30))])))
    sets = {d: {tuple(c[k : k + 5]) for k in range(51)} for d, t in rows for c in [t.split()[30:85]]}
    want = {d for d in sets if any(e < d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]) for e in sets)}
    got = {x.doc_id for x in passages.passages(frame(spark, rows)).where("NOT is_first").select("doc_id").distinct().collect()}
    assert want and got == want


def test_passages_with_a_word_inserted_or_deleted_are_found(spark):
    r, rows, pairs = random.Random(9), [], 120
    for d in range(pairs):
        copy = [f"p{d}x{k}" for k in range(52)]
        at = r.randrange(18, 34)
        other = [*copy[:at], "new", *copy[at:]] if d % 2 else [*copy[:at], *copy[at + 1 :]]
        for i, w in ((d, copy), (d + pairs, other)):
            rows.append((i, " ".join([*(f"a{i}x{k}" for k in range(30)), *w, *(f"b{i}x{k}" for k in range(30))])))
    got = {x.doc_id for x in passages.passages(frame(spark, rows)).where("NOT is_first").collect()}
    assert got == set(range(pairs, 2 * pairs))


# --- 6 ----------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def test_snapshots_collapse_into_maximal_conversations(spark):
    long = [("user", "a"), ("assistant", "b"), ("user", None), (None, "<|im_end|>")]
    talks = {1: long[:1], 2: long[:2], 3: long, 4: long[:3], 5: long, 6: [("user", "a"), ("assistant", "c")], 7: [("user", "")], 8: [("user", None)]}
    rows = [(c, 2 * i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost")]
    got = {r.conv_id: r for r in chat.render(frame(spark, rows, TURNS)).collect()}
    assert set(got) == {3, 6, 7, 8} and got[3].n_turns == 4
    assert got[3].rendered.startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n") and "unknown\n< |im_end|>" in got[3].rendered
    assert chat.render(frame(spark, [], TURNS)).count() == 0


# --- 7 ----------------------------------------------------------------------------------------------


def test_model_is_a_distribution_and_beats_counts(spark):
    r = random.Random(1)
    rows = []
    for d in range(300):  # two languages: what came before tells which
        words = WORDS[:20] if d % 2 else WORDS[20:40]
        rows.append((d, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))))
    rows += [(900, None), (901, ""), (902, "never seen"), (None, "bal bane")]
    got = {x.doc_id: x for x in recurrent.scored(frame(spark, rows), F.coalesce(F.col("doc_id"), F.lit(1)) % 5 != 0).collect()}
    c = Counter()
    for d, t in rows:
        if (1 if d is None else d) % 5:
            c.update([*(t or "").lower().split(), ""])
    size = np.log10(c.total() + len(c) + 1)
    for d, t in rows:
        w = [*(t or "").lower().split(), ""]
        assert got[d].base_score == pytest.approx(sum(np.log10(c[x] + 1) - size for x in w))
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(w), sum(x in c for x in w), c.total())
    held = [d for d, _ in rows if d is not None and d % 5 == 0 and d < 300]
    assert sum(got[d].score for d in held) > sum(got[d].base_score for d in held) + 50
    assert recurrent.scored(frame(spark, []), F.lit(True)).count() == 0


def test_gradients_are_those_of_small_steps():
    r = np.random.default_rng(3)
    net = recurrent.new_net(r.random(recurrent.CLASSES * recurrent.MEMBERS))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [r.integers(0, 4096, n) for n in (30, 7, 1, 22)]
    x, y, goes_on, counts = recurrent.laid_out(texts, 4)
    h = r.normal(0, 0.3, (4, recurrent.HIDDEN)).astype(np.float32)
    g, used, _, loss = recurrent.gradients(net.p, x, y, goes_on, counts, h)
    whole = {**g, "embed": np.zeros_like(net.p["embed"])}
    whole["embed"][used] = g["embed"]

    def by_steps(q):
        state, total = h.astype(np.float64), 0.0
        for t in range(len(x)):
            state = recurrent._step(q, q["embed"][x[t]] @ q["wx"] + q["b"], state * goes_on[t][:, None])[0]
            total -= recurrent.log_probabilities(q, state, y[t])[counts[t]].sum()
        return total / counts.sum()

    assert loss == pytest.approx(by_steps(p), rel=1e-4) and counts.sum() == 60
    for name, v in p.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in v.shape)
            if name == "embed":
                at = (int(r.choice(used)), at[1])
            if name in ("wm", "bm"):
                at = (int(r.choice(y[counts])) // recurrent.MEMBERS, *at[1:])
            up, down = ({**p, name: v.copy()} for _ in range(2))
            up[name][at] += 1e-4
            down[name][at] -= 1e-4
            assert whole[name][at] == pytest.approx((by_steps(up) - by_steps(down)) / 2e-4, abs=2e-5), (name, at)


def test_every_training_text_is_learned_from_and_learners_are_averaged(spark):
    r = np.random.default_rng(4)
    texts = [r.integers(0, 64, n).astype(np.int16) for n in (1, 2, 5, *r.integers(1, 60, 60))]
    net = recurrent.new_net(np.ones(recurrent.CLASSES * recurrent.MEMBERS))
    rows = spark.createDataFrame([(i % recurrent.ROUNDS, bytearray(t.tobytes())) for i, t in enumerate(texts)] + [(None, bytearray(b"xy"))], "turn int, out binary").repartition(3)
    got = recurrent.learned(rows, net, 3 * recurrent.LEARNER)
    before, after = (recurrent.text_log10(n, [t.astype(np.int64) for t in texts]).sum() for n in (net, got))
    assert after > before + 20 and recurrent.unflat(recurrent.flat(got), net).p["wm"].shape == net.p["wm"].shape
    assert np.array_equal(recurrent.flat(recurrent.learned(rows.where("turn > 99"), net, 0)), recurrent.flat(net))


def test_state_is_carried_over_windows():
    r = np.random.default_rng(0)
    net = recurrent.new_net(r.random(recurrent.CLASSES * recurrent.MEMBERS))
    text = r.integers(0, 4096, 100)
    h, last, total = np.zeros((1, recurrent.HIDDEN), np.float32), 4096, 0.0
    for y in text:
        gx = (net.p["embed"][[last]] @ net.p["wx"] + net.p["b"]).astype(np.float32)
        h = recurrent._step(net.p, gx, h)[0]
        logp = recurrent.log_probabilities(net.p, np.repeat(h, 4096, 0), np.arange(4096))
        assert np.exp(logp).sum() == pytest.approx(1, abs=1e-3)
        total += logp[y]
        last = y
    short = r.integers(0, 4096, 7)
    both = recurrent.text_log10(net, [short, text])
    assert both[1] == pytest.approx(total / np.log(10), rel=1e-4)
    assert both[0] == pytest.approx(recurrent.text_log10(net, [short])[0], rel=1e-5)


# --- 8 ----------------------------------------------------------------------------------------------


def test_bucket_ends_are_optimal():
    for seed in range(30):
        r = random.Random(seed)
        hist = sorted({r.randint(1, 30): r.randint(1, 9) for _ in range(r.randint(1, 9))}.items())
        k = r.randint(1, 4)

        def cost(ends, hist=hist):
            return sum(c * (min(e for e in ends if e >= n) - n) for n, c in hist)

        from itertools import combinations

        lengths = [n for n, _ in hist]
        want = min(cost((*x, lengths[-1])) for x in combinations(lengths[:-1], min(k, len(hist)) - 1))
        got = lengthpack.best_ends(hist, k)
        assert len(got) == min(k, len(hist)) and cost(got) == want
    assert lengthpack.best_ends([]) == []


def test_batches_keep_every_word_and_the_budget(spark):
    rows = [*ODD, *((i, prose(rng.randint(1, 90), i)) for i in range(100, 160))]
    got = lengthpack.batches(frame(spark, [(*r, 0) for r in rows], DOCS + ", piece int"), most=40, buckets=3, budget=100).collect()
    words = Counter()
    for r in got:
        words[r.doc_id] += r.n_words
        assert r.n_words <= r.bucket_end and r.padding == r.bucket_end - r.n_words
    want = Counter()
    for d, t in rows:
        want[d] += len((t or "").split())
    assert words == +want
    for (b, _), rs in {k: [r for r in got if (r.bucket, r.batch) == k] for k in {(r.bucket, r.batch) for r in got}}.items():
        assert len(rs) * rs[0].bucket_end <= 100 and len({r.bucket_end for r in rs}) == 1
    assert lengthpack.batches(frame(spark, [])).count() == 0


# --- 9 and 10 ---------------------------------------------------------------------------------------


def test_quality_learns_from_positives_and_unlabelled(spark):
    rows = [(d, prose(80, d) if d % 4 else " ".join(w.upper() + "!!" for w in prose(80, d).split())) for d in range(400)]
    labels = frame(spark, [(d, int(d % 4 > 0)) for d in range(400) if d % 5 < 3] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = frame(spark, [*rows, (1000, None), (1001, "")])
    model = quality.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    held = [d for d, _ in rows if d % 3 == 1]
    assert np.mean([got[d].predicted == int(d % 4 > 0) for d in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert quality.scored(frame(spark, []), none).count() == 0


def test_toxicity_is_not_learned_in_the_driver(spark, monkeypatch):
    docs = frame(spark, [(d, prose(20, d) + (" zorkly" if d % 5 == 0 else "")) for d in range(60)] + [(60, None), (61, "x" * 2_000), (3, "again")])
    labels = frame(spark, [(d, int(d % 5 == 0)) for d in range(62)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    texts, y, where = trained_in_task(docs, labels, F.lit(True), "toxic", lambda t, y: (t, y, os.getpid()), 50, 1_500)
    wanted, ys = training_rows(docs, labels, F.lit(True), "toxic", 50, 1_500)
    assert (texts, y.tolist()) == (wanted, ys.tolist()) and len(texts) > 5 and where != os.getpid()
    before = toxicity.train(*training_rows(docs, labels, F.lit(True), "toxic"))

    def fails(*_):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(toxicity, "train", fails)
    model = toxicity.fit(docs, labels, F.lit(True))
    assert np.array_equal(model.weights, before.weights) and model.bias == before.bias
    monkeypatch.undo()
    assert not toxicity.fit(docs.limit(0), labels, F.lit(True)).weights.any() and not toxicity.fit(docs, labels.where("false"), F.lit(True)).weights.any()


def test_toxic_sentences_are_learned_from_documents(spark):
    rows = [(d, ". ".join(prose(9, 10 * d + k) + (" zorkly" if d % 5 == 0 and k == 3 else "") for k in range(8))) for d in range(300)]
    docs = frame(spark, [*rows, (1000, None), (1001, "")])
    labels = frame(spark, [(d, int(d % 5 == 0)) for d in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [d for d, _ in rows if d % 4 == 2]
    assert np.mean([got[d].predicted == int(d % 5 == 0) for d in held]) > 0.95
    assert all("zorkly" in got[d].worst_sentence for d in held if d % 5 == 0)
    assert got[1000].score == 0 == got[1001].predicted
    left = toxicity.accepted(frame(spark, [(*r, 2.0) for r in rows] + [(1000, None, 2.0)], DOCS + ", score double"), model)
    assert left.columns == ["doc_id", "text", "score"] and 1000 in {r.doc_id for r in left.collect()}
    same = toxicity.train(["a b", "c"], np.array([0, 0]))
    assert not same.weights.any()
