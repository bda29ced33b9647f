"""Stable keys, seeds and uniform numbers from hashes: equal on every run, partition and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def caption_key(uid: Column, caption: Column) -> Column:
    """SHA-1 over the id, a zero byte and the caption."""
    return F.sha1(F.concat(F.encode(uid, "utf-8"), F.unhex(F.lit("00")), F.encode(caption, "utf-8")))


def image_uid(path: Column) -> Column:
    return F.concat(F.lit("img_"), F.left(F.sha1(F.encode(path, "utf-8")), F.lit(16)))


def seed(text: Column) -> Column:
    """SHA-256 of a text modulo 2^31."""
    return F.conv(F.right(F.sha2(text, 256), F.lit(8)), 16, 10).cast("bigint").bitwiseAND(2147483647)


def rollout_seed(index: Column, image_idx: Column) -> Column:
    return seed(F.concat_ws("_", index.cast("string"), image_idx.cast("string")))


def render_seed(index: Column) -> Column:
    return seed(F.concat(F.lit("dit_"), index.cast("string")))


def uniform(key: Column) -> Column:
    """A number from 0 to below 1 with 52 random bits of a key's SHA-256."""
    return F.conv(F.left(F.sha2(key, 256), F.lit(13)), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def weighted(u: Column, choices: list[tuple[str, float]]) -> Column:
    """The choice whose share of the summed weights a uniform number falls into."""
    total, so_far, out = float(sum(w for _, w in choices)), 0.0, None
    for name, w in choices[:-1]:
        so_far += w
        out = F.when(u < so_far / total, name) if out is None else out.when(u < so_far / total, name)
    return F.lit(choices[-1][0]) if out is None else out.otherwise(choices[-1][0])


def keep_probabilities(n: Column, strength: float, decay: float, epsilon: float = 1e-3, scale: float = 1.0) -> Column:
    """Falling probabilities for ``n`` list items; a single item has ``scale``, none an empty array."""
    strength, decay, epsilon = min(max(strength, 0.0), 1.0), max(decay, 1e-9), min(max(epsilon, 1e-9), 0.05)
    raw = lambda i: (epsilon + (1 - 2 * epsilon) * strength * F.exp(-decay * i / (n - 1))) * scale
    many = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(2)) - 1), lambda i: F.least(F.greatest(raw(i), F.lit(epsilon)), F.lit(1 - epsilon)))
    return F.when(n <= 0, F.array().cast("array<double>")).when(n == 1, F.array(F.lit(scale))).otherwise(many)
