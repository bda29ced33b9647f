"""Scores of whole texts by a gated recurrent language model.

The output vocabulary is a fixed number of frequent words, and for all others a fixed number of tails:
a word's tail is found from its last bytes, and inside a tail words have their smoothed counts. A
softmax over classes and another inside the class give the probability of the next output. The model is
trained by truncated backpropagation on all training texts, as counts of words are: texts are dealt to
rounds, in a round each learner (a task with some millions of tokens) goes on from the same weights over
its own texts, and the mean of the learners' weights begins the next round. The number of learners grows
with the corpus. Scoring carries the state from window to window, so every text is scored from its first
token to its end.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, need, split_words

#: CLASSES x MEMBERS outputs, of which TAILS stand for all words that have no output of their own.
CLASSES, MEMBERS, TAILS, HIDDEN = 64, 64, 128, 24
#: Words whose counts every task has; the counts of others are joined. About 30 bytes a word.
HEAD = 1 << 17
#: Texts side by side at most, and steps in a window; the learning rate at the beginning.
STREAMS, WINDOW, RATE = 512, 24, 1.5e-2
#: Rounds of learning, tokens of a learner in all of them, and updates that a small corpus is gone over again for in a round.
ROUNDS, LEARNER, UPDATES = 4, 4_000_000, 40
#: Parts that the weights of learners are averaged in, and outputs that a learner holds at once.
_SLICES, _HELD = 32, 2_000_000
END = b""
#: Texts that are scored side by side, and words of which a task gathers counts before it hands them on.
_LANES, _COUNTED = 512, 400_000
#: States that wait for their outputs, and bytes of outputs whose documents are scored together.
_WAITING, _TOGETHER = 1 << 13, 6_000_000


def tail_of(word: bytes) -> int:
    """Which of the tails stands for a word; words with one ending share it."""
    return xxhash.xxh3_64_intdigest(word.rstrip(b".,;:!?")[-3:]) % TAILS


def counts(docs: DataFrame) -> DataFrame:
    """``word`` (binary), ``n``, ``tail`` of all tokens of ``docs`` (``text``), an empty word being the end.

    Tasks combine counts before the shuffle and hand them on when they have gathered many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                found.update(split_words(t.as_py()))
                found[END] += 1
                if len(found) >= _COUNTED:
                    yield from hand_on(found)
                    found = Counter()
        yield from hand_on(found)

    def hand_on(found: Counter) -> Iterator[pa.RecordBatch]:
        words = list(found)
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.binary()), pa.array([found[w] for w in some], pa.int64()), pa.array([tail_of(w) for w in some], pa.int32())], names=["word", "n", "tail"]
            )

    each = docs.select("text").mapInArrow(run, "word binary, n long, tail int")
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.max("tail").alias("tail"))


@dataclass
class Net:
    """Weights by name; see :func:`new_net`."""

    p: dict[str, np.ndarray] = field(default_factory=dict)


def new_net(mass: np.ndarray, seed: int = 3) -> Net:
    """A net whose outputs have, before training, the probabilities ``mass`` whatever came before."""
    rng = np.random.default_rng(seed)
    n, h = CLASSES * MEMBERS, HIDDEN
    mass = np.maximum(mass, mass[mass > 0].min() * 0.1 if (mass > 0).any() else 1.0)
    by_class = mass.reshape(CLASSES, MEMBERS)
    draw = lambda *s, k=1.0: (rng.normal(0, k / np.sqrt(s[-2] if len(s) > 1 else 1), s)).astype(np.float32)
    f = np.float32
    return Net({
        "embed": draw(n + 1, h, k=2.0), "wx": draw(h, 3 * h), "wh": draw(h, 3 * h), "b": np.zeros(3 * h, f),
        "wc": draw(h, CLASSES, k=0.1), "bc": np.log(by_class.sum(1) / mass.sum()).astype(f),
        "wm": draw(CLASSES, h, MEMBERS, k=0.1), "bm": np.log(by_class / by_class.sum(1, keepdims=True)).astype(f),
    })


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _step(p: dict, gx: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of gated recurrence from the input's part of the gates, ``gx``, and the state ``h``."""
    k = HIDDEN
    gh = h @ p["wh"]
    rz = _sig(gx[:, : 2 * k] + gh[:, : 2 * k])
    r, z = rz[:, :k], rz[:, k:]
    c = np.tanh(gx[:, 2 * k :] + r * gh[:, 2 * k :])
    return c + z * (h - c), r, z, c, gh[:, 2 * k :]


def _log_sum_exp(x: np.ndarray, bound: float) -> np.ndarray:
    """Of each row of ``x``, which is overwritten and has no number beyond ``bound`` on either side of 0."""
    top = x.max(1) if bound > 80 else None  # single precision holds exp(80) and exp(-80)
    if top is not None:
        x -= top[:, None]
    for lo in range(0, len(x), 2048):  # parts that stay in the processor's cache
        np.exp(x[lo : lo + 2048], out=x[lo : lo + 2048])
    got = np.log(x @ np.ones(x.shape[1], x.dtype))
    return got if top is None else got + top


def _bounds(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far from 0 the outputs of weights can be, for states between -1 and 1."""
    return (np.abs(w).sum(-2) + np.abs(b)).max(-1)


def _classes(out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """An order of outputs by class, their classes and members in it, and the slice of each class that has any."""
    cls = out // MEMBERS
    order = np.argsort(cls.astype(np.int16), kind="stable")
    sizes = np.bincount(cls, minlength=CLASSES)
    ends = np.cumsum(sizes)
    used = [(i, slice(int(hi - n), int(hi))) for i, (hi, n) in enumerate(zip(ends, sizes, strict=True)) if n]
    return order, cls[order], out[order] % MEMBERS, used


def log_probabilities(p: dict, states: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Natural logs of the probabilities of the outputs ``out`` after ``states``."""
    order, cls, member, used = _classes(out)
    s, rows = states[order], np.arange(out.size)
    x = s @ p["wc"]
    x += p["bc"]
    got = x[rows, cls]
    got -= _log_sum_exp(x, float(_bounds(p["wc"], p["bc"])))
    x = np.empty((out.size, MEMBERS), x.dtype)
    for c, at in used:
        np.matmul(s[at], p["wm"][c], out=x[at])
        x[at] += p["bm"][c]
    got += x[rows, member]
    got -= _log_sum_exp(x, float(_bounds(p["wm"], p["bm"]).max()))
    back = np.empty_like(got)
    back[order] = got
    return back


def laid_out(texts: list[np.ndarray], streams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, outputs, whether a state goes on and whether an output counts, each as (steps, streams).

    Texts follow each other; the whole is cut into ``streams`` equal parts, the last of which is filled up with
    outputs that don't count. A part that begins inside a text begins with an empty state and the start as input.
    """
    start, sizes = CLASSES * MEMBERS, np.array([t.size for t in texts])
    whole = np.concatenate(texts).astype(np.int64)
    first = np.zeros(whole.size, bool)
    first[np.cumsum(sizes) - sizes] = True
    steps = -(-whole.size // streams)
    rest = steps * streams - whole.size
    y = np.r_[whole, np.zeros(rest, np.int64)].reshape(streams, steps).T
    begin = np.r_[first, np.ones(rest, bool)].reshape(streams, steps).T.copy()
    begin[0] = True
    counts = np.r_[np.ones(whole.size, bool), np.zeros(rest, bool)].reshape(streams, steps).T
    x = np.where(begin, start, np.concatenate([np.full((1, streams), start), y[:-1]]))
    return np.ascontiguousarray(x), np.ascontiguousarray(y), ~begin, np.ascontiguousarray(counts)


def _softmax_slopes(x: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """In place of the outputs ``x``, the slope of their weighted loss, whose value comes beside it."""
    x -= x.max(1, keepdims=True)
    rows = np.arange(at.size)
    own = x[rows, at]
    for lo in range(0, len(x), 2048):  # parts that stay in the processor's cache
        np.exp(x[lo : lo + 2048], out=x[lo : lo + 2048])
    sums = x @ np.ones(x.shape[1], np.float32)
    x *= (weight / sums)[:, None]
    x[rows, at] -= weight
    return x, float(weight @ (np.log(sums) - own))


def gradients(p: dict, x: np.ndarray, y: np.ndarray, goes_on: np.ndarray, counts: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, float]:
    """Of the mean loss over a window: gradients by weight, the inputs that ``embed``'s rows are of, the last state, the loss.

    Backpropagation goes through the window's steps and ends at its first: ``h``, the state before it, is taken as given.
    """
    (n, streams), k = x.shape, HIDDEN
    total = n * streams
    xs = x.reshape(-1)
    e = p["embed"][xs]
    gx = (e @ p["wx"] + p["b"]).reshape(n, streams, 3 * k)
    keep, carry = goes_on[:, :, None].astype(np.float32), ~goes_on
    hs, before, c, q = (np.empty((n, streams, k), np.float32) for _ in range(4))
    rz = np.empty((n, streams, 2 * k), np.float32)
    for t in range(n):
        at = before[t]
        np.multiply(h, keep[t], out=at) if carry[t].any() else np.copyto(at, h)
        gh = at @ p["wh"]
        gate = np.add(gx[t, :, : 2 * k], gh[:, : 2 * k], out=rz[t])
        gate *= np.float32(0.5)
        np.tanh(gate, out=gate)
        gate += np.float32(1)
        gate *= np.float32(0.5)
        q[t] = gh[:, 2 * k :]
        new = np.multiply(gate[:, :k], q[t], out=c[t])
        new += gx[t, :, 2 * k :]
        np.tanh(new, out=new)
        h = np.subtract(at, new, out=hs[t])
        h *= gate[:, k:]
        h += new
    s, ys = hs.reshape(total, k), y.reshape(-1)
    weight = counts.reshape(-1).astype(np.float32)
    weight /= max(1.0, float(weight.sum()))
    order, cls, member, used = _classes(ys)
    s, weight, g = s[order], weight[order], {}
    d = s @ p["wc"]
    d += p["bc"]
    d, loss = _softmax_slopes(d, cls, weight)
    g["wc"], g["bc"], ds = s.T @ d, np.ones(total, np.float32) @ d, d @ p["wc"].T
    d = np.empty((total, MEMBERS), np.float32)
    for i, at in used:
        np.matmul(s[at], p["wm"][i], out=d[at])
        d[at] += p["bm"][i]
    d, part = _softmax_slopes(d, member, weight)
    g["wm"], g["bm"] = np.zeros_like(p["wm"]), np.zeros_like(p["bm"])
    for i, at in used:
        np.matmul(s[at].T, d[at], out=g["wm"][i])
        g["bm"][i] = d[at].sum(0)
        ds[at] += d[at] @ p["wm"][i].T
    back = np.empty_like(ds)
    back[order] = ds
    ds = back.reshape(n, streams, k)
    # what a state's slope is multiplied by on its way to each gate
    r, z = rz[:, :, :k], rz[:, :, k:]
    to_c = 1 - c * c
    to_c *= 1 - z
    to_z = before - c
    to_z *= z * (1 - z)
    to_r = q * r
    to_r *= 1 - r
    dgx, dgh = np.empty((n, streams, 3 * k), np.float32), np.empty((n, streams, 3 * k), np.float32)
    turned, dh = p["wh"].T.copy(), np.zeros((streams, k), np.float32)
    for t in range(n - 1, -1, -1):
        dh += ds[t]
        flat, ahead = dgx[t], dgh[t]
        dc = np.multiply(dh, to_c[t], out=flat[:, 2 * k :])
        np.multiply(dh, to_z[t], out=flat[:, k : 2 * k])
        np.multiply(dc, to_r[t], out=flat[:, :k])
        ahead[:, : 2 * k] = flat[:, : 2 * k]
        np.multiply(dc, r[t], out=ahead[:, 2 * k :])
        dh *= z[t]
        dh += ahead @ turned
        if carry[t].any():
            dh *= keep[t]
    flat = dgx.reshape(total, 3 * k)
    g["wh"] = before.reshape(total, k).T @ dgh.reshape(total, 3 * k)
    g["wx"], g["b"] = e.T @ flat, np.ones(total, np.float32) @ flat
    # rows of the embedding by input: sums over sorted inputs
    order = np.argsort(xs.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(xs[order]) != 0])
    g["embed"] = np.add.reduceat((flat @ p["wx"].T)[order], first, axis=0)
    return g, xs[order[first]], hs[-1], loss + part


def train(net: Net, texts: list[np.ndarray], rate: float = RATE, last_rate: float = RATE / 10, updates: int = UPDATES) -> Net:
    """A copy of ``net`` after truncated backpropagation by Adam over all of ``texts``.

    Texts follow each other in parallel streams of windows; the state passes from window to window and is zero
    again after each text's end. Few texts are gone over as often as makes ``updates``. Rates fall in a line.
    Without texts the net stays as it is.
    """
    p = {k: v.copy() for k, v in net.p.items()}
    size = sum(t.size for t in texts)
    if not size:
        return Net(p)
    x, y, goes_on, counts = laid_out(texts, int(np.clip(size // (8 * WINDOW), 4, STREAMS)))
    one, two = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    windows, done = -(-len(x) // WINDOW), 0
    passes = max(1, updates // windows)
    for _ in range(passes):
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        for w in range(windows):
            at = slice(w * WINDOW, (w + 1) * WINDOW)
            g, used, h, _ = gradients(p, x[at], y[at], goes_on[at], counts[at], h)
            now = rate + (last_rate - rate) * done / max(1, passes * windows - 1)
            done += 1
            cut = np.float32(min(1.0, 1.0 / (np.sqrt(sum(float((v * v).sum()) for v in g.values())) + 1e-9)))
            right1, right2 = 1 - 0.9**done, 1 - 0.99**done
            for name, d in g.items():
                to = used if name == "embed" else slice(None)
                d = d * cut
                m1, m2 = one[name][to], two[name][to]
                m1 = m1 + np.float32(0.1) * (d - m1)
                m2 = m2 + np.float32(0.01) * (d * d - m2)
                one[name][to], two[name][to] = m1, m2
                p[name][to] -= np.float32(now / right1) * m1 / (np.sqrt(m2 / np.float32(right2)) + np.float32(1e-6))
    return Net(p)


def flat(net: Net) -> np.ndarray:
    """All weights in a row, by name."""
    return np.concatenate([net.p[k].reshape(-1) for k in sorted(net.p)])


def unflat(values: np.ndarray, like: Net) -> Net:
    """The net whose weights :func:`flat` has laid in a row."""
    out, at = {}, 0
    for k in sorted(like.p):
        size = like.p[k].size
        out[k] = values[at : at + size].astype(np.float32).reshape(like.p[k].shape)
        at += size
    return Net(out)


def learned(encoded: DataFrame, net: Net, tokens: int, rounds: int = ROUNDS, learner: int = LEARNER) -> Net:
    """``net`` after ``rounds`` of learning over all texts of ``encoded`` (``out``: outputs as 16 bits, ``turn``: the round).

    In a round each task trains its own copy on its texts, some ``learner`` tokens over all rounds; the mean of the
    copies, weighted by tokens, begins the next round. Weights are averaged in slices by tasks: the driver gets one
    net a round, whatever the number of learners. ``encoded`` should be checkpointed: it is read in each round.
    """
    learners, spark = max(1, round(tokens / learner)), encoded.sparkSession
    parts = np.array_split(np.arange(flat(net).size), _SLICES)
    for turn in range(rounds):
        rate, last = (RATE * (1 - 0.95 * t / rounds) for t in (turn, turn + 1))
        held = spark.sparkContext.broadcast(net)  # a net of fixed size

        def run(batches: Iterator[pa.RecordBatch], held=held, rate=rate, last=last) -> Iterator[pa.RecordBatch]:
            own, texts, size, seen = held.value, [], 0, 0
            for batch in batches:
                for out in batch["out"]:
                    texts.append(np.frombuffer(out.as_buffer(), np.int16))
                    size += texts[-1].size
                    if size >= _HELD:
                        own, seen = train(own, texts, rate, last), seen + size
                        texts, size = [], 0
            if texts:
                own, seen = train(own, texts, rate, last), seen + size
            if seen:
                weights = flat(own).astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(_SLICES), pa.int32()), pa.array([weights[at].tobytes() for at in parts], pa.binary()), pa.array([seen] * _SLICES, pa.int64())], names=["part", "sums", "n"]
                )

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for part, values, n in zip(batch["part"].to_pylist(), batch["sums"], batch["n"].to_pylist(), strict=True):
                    had = sums.setdefault(part, [0.0, 0])
                    had[0], had[1] = had[0] + np.frombuffer(values.as_buffer()), had[1] + n
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], names=["part", "sums", "n"]
                )

        kind = "part int, sums binary, n long"
        texts = encoded.where((F.col("turn") == turn)).select("out").coalesce(learners)
        got = texts.mapInArrow(run, kind).repartition(_SLICES, "part").mapInArrow(added, kind).collect()  # _SLICES rows: one net
        if got:
            mean = {r.part: np.frombuffer(r.sums) / r.n for r in got}
            net = unflat(np.concatenate([mean[i] for i in range(_SLICES)]), net)
        held.unpersist()
    return net


def in_lanes(sizes: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane and place in it of texts that are laid end to end, longest first, each in the lane that is shortest so far;
    and the lanes' lengths. Lanes are numbered by falling length."""
    load, lane, place = [(0, i) for i in range(lanes)], np.zeros(sizes.size, np.int64), np.zeros(sizes.size, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        length, at = load[0]
        lane[i], place[i] = at, length
        heapq.heapreplace(load, (length + int(sizes[i]), at))
    length = np.zeros(lanes, np.int64)
    length[[at for _, at in load]] = [n for n, _ in load]
    rank = np.empty(lanes, np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(lanes)
    return rank[lane], place, np.sort(length)[::-1]


def text_log10(net: Net, texts: list[np.ndarray]) -> np.ndarray:
    """The log10 probability of the outputs of each text, from its first to its last.

    Texts go side by side in lanes, in which one begins with an empty state where another ends; the state is carried
    from window to window. States wait until there are enough of them for their outputs' probabilities.
    """
    p, start, sums, k = net.p, CLASSES * MEMBERS, np.zeros(len(texts)), HIDDEN
    sizes = np.array([t.size for t in texts], np.int64)
    if not sizes.sum():
        return sums
    # gates take half of their input, as tanh makes them of it
    half = np.r_[np.full(2 * k, 0.5), np.ones(k)].astype(np.float32)
    gates, wh = ((p["embed"] @ p["wx"] + p["b"]) * half).astype(np.float32), (p["wh"] * half).astype(np.float32)
    lane, place, length = in_lanes(sizes, min(_LANES, len(texts)))
    steps = -(-int(length[0]) // WINDOW) * WINDOW
    y, owner, begins = np.zeros((length.size, steps), np.int16), np.full((length.size, steps), -1, np.int32), np.zeros((length.size, steps), bool)
    for i, (at, to, n) in enumerate(zip(lane.tolist(), place.tolist(), sizes.tolist(), strict=True)):
        y[at, to : to + n], owner[at, to : to + n] = texts[i], i
        begins[at, to : to + 1] = True
    h, last = np.zeros((length.size, k), np.float32), np.full(length.size, start)
    waiting: list[tuple[np.ndarray, ...]] = []
    held = 0
    for t0 in range(0, steps, WINDOW):
        live, at = int((length > t0).sum()), slice(t0, t0 + WINDOW)
        ys, own, new_text = y[:live, at].T.astype(np.int64), owner[:live, at].T, begins[:live, at].T
        x = np.where(new_text, start, np.concatenate([last[:live][None], ys[:-1]]))
        h, last = h[:live], ys[-1]
        states = np.empty((WINDOW, live, k), np.float32)
        resets, going = new_text.any(1), (~new_text[:, :, None]).astype(np.float32)
        for t in range(WINDOW):
            if resets[t]:
                h = h * going[t]
            g, gh = gates[x[t]], h @ wh
            gate = g[:, : 2 * k]
            gate += gh[:, : 2 * k]
            np.tanh(gate, out=gate)
            gate += np.float32(1)
            gate *= np.float32(0.5)
            new = gh[:, 2 * k :]
            new *= gate[:, :k]
            new += g[:, 2 * k :]
            np.tanh(new, out=new)
            h = np.subtract(h, new, out=states[t])
            h *= gate[:, k:]
            h += new
        real = own >= 0
        waiting.append((states.reshape(-1, k), ys.reshape(-1), own.reshape(-1)) if real.all() else (states[real], ys[real], own[real]))
        held += waiting[-1][2].size
        if held >= _WAITING or t0 + WINDOW == steps:
            s, out, text = map(np.concatenate, zip(*waiting, strict=True))
            sums += np.bincount(text, log_probabilities(p, s, out), sums.size)
            waiting, held = [], 0
    return sums / np.log(10)


@dataclass(frozen=True)
class Vocabulary:
    """The most frequent words: their outputs and counts, and the tails' totals."""

    words: list[bytes]
    count: np.ndarray
    output: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    tokens: int
    distinct: int


def vocabulary(found: DataFrame) -> Vocabulary:
    """From all counts: the most frequent words, HEAD at most, and sums by tail.

    A histogram of counts by 64ths of powers of two, of a few thousand rows at most, says from which count on
    words fit into the head; only those are collected.
    """
    step = F.floor(F.log2("n") * 64)
    room, least = HEAD, None
    for r in sorted(found.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r.step):
        room -= r.v
        if room < 0:
            break
        least = r.step
    head = [] if least is None else sorted(found.where(step >= least).collect(), key=lambda r: (-r.n, bytes(r.word)))
    words = [bytes(r.word) for r in head]
    count = np.array([r.n for r in head], np.int64)
    own = min(len(words), CLASSES * MEMBERS - TAILS)
    sums = found.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tokens, distinct = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in sums:
        tokens[r.tail], distinct[r.tail] = r.n, r.v
    total, every = int(tokens.sum()), int(distinct.sum())
    for r in head[:own]:
        tokens[r.tail] -= r.n
        distinct[r.tail] -= 1
    mass = np.r_[count[:own], np.zeros(CLASSES * MEMBERS - TAILS - own, np.int64), tokens]
    rank = np.empty(mass.size, np.int64)
    rank[np.argsort(-mass, kind="stable")] = np.arange(mass.size)  # classes hold outputs of like frequency
    tails = rank[CLASSES * MEMBERS - TAILS :]
    output = np.r_[rank[:own], [tails[r.tail] for r in head[own:]]].astype(np.int64)
    return Vocabulary(words, count, np.r_[output, tails], tokens, distinct, total, every)


class Reader:
    """Turns texts into outputs and into what their words outside the outputs add."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.index = v, {w: i for i, w in enumerate(v.words)}
        self.own = min(len(v.words), CLASSES * MEMBERS - TAILS)
        self.base = np.log10(v.count + 1.0)
        self.known, self.tails = {}, v.output[len(v.words) :]
        self.tail_cost = -np.log10(v.tail_tokens + v.tail_words + 1.0)

    def read(self, text: str | None) -> tuple[np.ndarray, int, float, int, float, list[bytes]]:
        """Outputs; tokens; sum of log10(c + 1) and number of tokens in the head; what tails add; other words."""
        words = [*split_words(text), END]
        get = self.index.get
        at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        out = self.v.output[at] if self.v.words else np.zeros(at.size, np.int64)
        missing = np.flatnonzero(at < 0)
        others = [words[i] for i in missing.tolist()]
        tail = np.fromiter(map(tail_of, others), np.int64, len(others))
        out[missing] = self.tails[tail]
        inside = at[at >= 0]
        in_tail = inside[inside >= self.own]
        extra = float(self.tail_cost[tail].sum())
        if in_tail.size:
            # a head word without an output of its own: its tail's share, and its count in the tail
            number = np.searchsorted(self.sorted_tails, self.v.output[in_tail])
            extra += float(self.tail_cost[self.tail_order[number]].sum() + self.base[in_tail].sum())
        return out, len(words), float(self.base[inside].sum()), int(inside.size), extra, others

    @property
    def tail_order(self) -> np.ndarray:
        if "order" not in self.known:
            self.known["order"] = np.argsort(self.tails)
        return self.known["order"]

    @property
    def sorted_tails(self) -> np.ndarray:
        if "sorted" not in self.known:
            self.known["sorted"] = self.tails[self.tail_order]
        return self.known["sorted"]


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of _TOGETHER bytes of outputs, or little more: the longest text of a list delays the others."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch["out"].nbytes
        if size >= _TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def scored(docs: DataFrame, trusted: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Training texts are those that ``trusted`` (over ``doc_id``) admits; null text is as empty, and an empty
    text is its end alone. With t tokens of V kinds in all training texts, ``base_score`` sums
    log10((c + 1) / (t + V + 1)), c being a token's count. ``score`` is the model's log10 probability of the
    text; the model learns from all training texts. Repeated rows and null ids are scored like others; an empty
    table gives an empty result. Without training texts all counts are zero and the net is untrained.
    A table of fewer parts than the cluster has cores is dealt out first.
    """
    rows = need(docs, doc_id=id_col, text=text_col)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores, F.xxhash64("text"))
    learn = rows.where(trusted)
    found = checkpointed(counts(learn))
    v = vocabulary(found)
    mass = np.zeros(CLASSES * MEMBERS)
    own = min(len(v.words), CLASSES * MEMBERS - TAILS)
    np.add.at(mass, v.output[:own], v.count[:own])
    mass[v.output[len(v.words) :]] = v.tail_tokens
    held = docs.sparkSession.sparkContext.broadcast(v)  # HEAD words
    kind = dict(rows.dtypes)["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reads = Reader(held.value)
        for batch in batches:
            out, n, base, known, extra, others = ([] for _ in range(6))
            for t in batch["text"]:
                for one, to in zip(reads.read(t.as_py()), (out, n, base, known, extra, others), strict=True):
                    to.append(one)
                out[-1] = out[-1].astype(np.int16).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["doc_id"], batch["turn"], pa.array(out, pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(extra, pa.float64()), pa.array(others, pa.list_(pa.binary()))],
                names=["row", "doc_id", "turn", "out", "n_tokens", "n_known", "base", "extra", "others"],
            )

    # numbered before the only pass that reads; the checkpoint keeps numbers and outputs together
    turn = F.when(F.coalesce(trusted, F.lit(False)), F.pmod(F.xxhash64("text"), F.lit(ROUNDS)).cast("int"))
    numbered = rows.select("doc_id", "text", turn.alias("turn")).withColumn("row", F.monotonically_increasing_id())
    each = checkpointed(numbered.mapInArrow(encode, f"row long, doc_id {kind}, turn int, out binary, n_tokens long, n_known long, base double, extra double, others array<binary>"))
    net = learned(each, new_net(mass), v.tokens) if v.words else new_net(np.ones(CLASSES * MEMBERS))
    model = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in together(batches):
            out, lo = [np.frombuffer(x.as_buffer(), np.int16) for batch in some for x in batch["out"]], 0
            score = text_log10(model.value, out)
            for batch in some:
                at = slice(lo, lo := lo + batch.num_rows)
                columns = [batch[c] for c in ("row", "doc_id", "n_tokens", "n_known", "base")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score[at] + batch["extra"].to_numpy())], names=["row", "doc_id", "n_tokens", "n_known", "base", "score"])

    scores = each.drop("turn", "others").mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double")
    others = each.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("m"))
    joined = others.join(found.select("word", "n"), "word").groupBy("row").agg(
        F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("add")
    )
    size = float(np.log10(v.tokens + v.distinct + 1.0))
    return scores.join(joined, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("score") + F.coalesce("add", F.lit(0.0))).alias("score"),
    )
