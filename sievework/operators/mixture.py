"""Mixtures of datasets, dropout of conditions, batches by length, and generated prompt suites, by hashed chance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.functions.hashing import uniform
from sievework.operators.statistics import numbered, running_sum

# --- mixtures -------------------------------------------------------------------------------------------


def mixed(rows: DataFrame, group: str, order: list[str], weights: dict[str, float], key: str = "mix", limit: int | None = None) -> DataFrame:
    """``rows`` with their ``place`` in a mixture that draws groups by weight.

    The draw at place k goes to the group that the uniform number of ``key|k`` falls on. A group's rows come in their
    own order, and the j-th draw of a group has its j-th row. The mixture ends where a group has run out of rows (or at
    ``limit``), and the rows that are left over are not returned. Places are numbered over ranges; the expected number
    of draws, and a margin, bounds the table of draws.
    """
    names = [g for g, w in weights.items() if w > 0]
    total = float(sum(weights[g] for g in names))
    known = rows.where(F.col(group).isin(*names))
    sizes = {r[0]: r[1] for r in known.groupBy(group).count().collect()}  # a row for each group
    if set(sizes) != set(names):
        return known.withColumn("place", F.lit(None).cast("long")).where(F.lit(False))
    # no group can be drawn more often than it has rows: the shortest in relation to its weight ends the mixture
    end = min(sizes[g] * total / weights[g] for g in names)
    n = min(int(end + 6 * end**0.5 + 100), limit or 1 << 62)
    u, so_far, pick = uniform(F.concat_ws("|", F.lit(key), F.col("place").cast("string"))), 0.0, F.when(F.lit(False), "")
    for g in names:
        so_far += weights[g]
        pick = pick.when(u < so_far / total, F.lit(g))
    draws = known.sparkSession.range(n).withColumnRenamed("id", "place").select("place", F.coalesce(pick, F.lit(names[-1])).alias(group))
    nth = numbered(draws, ["place"], "__nth", [group])
    own = numbered(known, order, "__nth", [group])
    beyond = nth.join(known.sparkSession.createDataFrame(list(sizes.items()), f"{group} string, __size long"), group).where("__nth >= __size").agg(F.min("place")).collect()[0][0]
    got = own.join(nth, [group, "__nth"]).drop("__nth")
    return got if beyond is None else got.where(F.col("place") < beyond)


def dropped_conditions(key: Column, shares: dict[str, float]) -> Column:
    """For every condition whether it is left out, by hashed chance from a sample's ``key`` and the condition's name."""
    return F.struct(*[(uniform(F.concat_ws("|", key, F.lit(name))) < share).alias(name) for name, share in shares.items()])


#: Shares of samples that are trained without a condition.
DROPOUT = {"text": 0.1, "vit": 0.4, "vae": 0.1}


def two_piece_uniform(u: Column, v: Column, mean: float) -> Column:
    """A number from 0 to 1 of the given mean: below it with a chance of 1 - mean, above it else, evenly on either side."""
    if not 0 < mean < 1:
        raise ValueError("the mean is between 0 and 1")
    return F.when(u < 1 - mean, v * mean).otherwise(mean + v * (1 - mean))


def composed(total: Column, key: Column, decay: float = 1.0) -> Column:
    """Lengths of the parts, in order, that ``total`` frames are divided into by hashed chance.

    The number of parts N, from 1 to the total, has chances that fall by ``decay`` from one to the next (1: all alike);
    the cuts are the N - 1 places between frames with the least uniform numbers. No frames have no parts.
    """
    u = lambda *k: uniform(F.concat_ws("|", key, *k))
    share = u(F.lit("parts"))
    if decay == 1.0:
        n = F.least(F.floor(share * total).cast("int") + 1, total)
    else:
        # the smallest N with 1 - decay^N >= share (1 - decay^total)
        n = F.least(F.greatest(F.ceil(F.log(F.lit(1) - share * (1 - F.pow(F.lit(decay), total))) / float(np.log(decay))).cast("int"), F.lit(1)), total)
    places = F.when(total > 1, F.sequence(F.lit(1), F.greatest(total, F.lit(2)) - 1)).otherwise(F.array().cast("array<int>"))
    shuffled = F.sort_array(F.transform(places, lambda i: F.struct(u(F.lit("cut"), i.cast("string")).alias("u"), i.alias("i"))))
    # the cuts are bound, else each part would hash and sort all places again
    cuts = F.concat(F.array(F.lit(0)), F.sort_array(F.transform(F.slice(shuffled, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x: x["i"])), F.array(total.cast("int")))
    parts = F.transform(F.array(cuts), lambda c: F.zip_with(F.slice(c, F.lit(2), F.size(c) - 1), F.slice(c, F.lit(1), F.size(c) - 1), lambda x, y: x - y))[0]
    return F.when(total > 0, parts).otherwise(F.array().cast("array<int>"))


# --- packs ----------------------------------------------------------------------------------------------


def with_mandatory(rows: DataFrame, shard: str, order: str, cost: str, group: str, mandatory: list[str], limit: int = 36_864, expected: int = 32_768, single: int = 16_384, tries: int = 5) -> DataFrame:
    """``shard``, ``order``, ``pack``, ``state`` of samples packed one after the other, each pack beginning with one sample
    of every mandatory group.

    A mandatory sample must be shorter than ``single`` and fit below ``limit``, strictly; others of its group are
    skipped, at most ``tries`` for a pack, after which the pack goes on without the group. Then samples follow in order
    until a pack has ``expected`` tokens or one does not fit, which then begins the next pack. A shard bounds what a task
    holds.
    """
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        queues = {g: [] for g in mandatory}
        rest = []
        for name, g, c in zip(pdf[order], pdf[group], pdf[cost].astype(int), strict=True):
            (queues[g] if g in queues else rest).append((name, c))
        for q in (*queues.values(), rest):
            q.reverse()
        out, pack = [], 0
        while rest or any(queues.values()):
            used = 0
            for q in queues.values():
                for _ in range(tries):
                    if not q:
                        break
                    name, c = q.pop()
                    if c < single and used + c < limit:
                        out.append((name, pack, "mandatory"))
                        used += c
                        break
                    out.append((name, -1, "skipped"))
            filled = used
            while rest and used < expected:
                name, c = rest[-1]
                if c > single:
                    out.append((name, -1, "skipped"))
                elif used + c > limit:
                    break
                else:
                    out.append((name, pack, "packed"))
                    used += c
                rest.pop()
            if not used and not filled and not rest:
                continue
            pack += 1
        got = pd.DataFrame(out, columns=[order, "pack", "state"])
        got.insert(0, shard, pdf[shard].iloc[0])
        return got

    return rows.select(shard, order, cost, group).groupBy(shard).applyInPandas(run, f"{shard} {kinds[shard]}, {order} {kinds[order]}, pack int, state string")


def template_lengths(caption: Column, prefix: int = 34, suffix: int = 5) -> Column:
    """Tokens of a caption in a template: what the text encoder gets, what the packed sequence has, and where the caption
    begins in the former. The prefix is encoded, but is no part of the sequence."""
    return F.struct((caption + prefix + suffix).alias("encoder"), (caption + suffix).alias("sequence"), F.lit(prefix).alias("begin"))


def padded(images: DataFrame, pack: str, sizes: list[str]) -> DataFrame:
    """``images`` with the greatest size of their pack in each dimension, to which all of it are padded."""
    most = images.groupBy(pack).agg(*[F.max(s).alias(f"padded_{s}") for s in sizes])
    return images.join(most, pack)


def padded_tail(packs: DataFrame, pack: str, order: str, length: str, budget: int) -> DataFrame:
    """Splits of each pack and one more, causal, that fills it up to ``budget``; a full pack has none more."""
    used = packs.groupBy(pack).agg(F.sum(length).cast("long").alias("__used"), F.max(order).alias("__last"))
    tail = used.where(F.col("__used") < budget).select(pack, (F.col("__last") + 1).alias(order), (budget - F.col("__used")).alias(length), F.lit("causal").alias("attention"))
    return packs.select(pack, order, F.col(length).cast("long").alias(length), "attention").unionByName(tail)


# --- batches --------------------------------------------------------------------------------------------


def length_batches(rows: DataFrame, length: str, order: list[str], size: int, steps: tuple[int, ...] = (128, 256)) -> DataFrame:
    """``rows`` with ``bucket`` (the first step that holds their length; the last holds the rest) and ``batch``, so many rows
    of one bucket in ``order``."""
    bucket = F.lit(len(steps) - 1)
    for i in range(len(steps) - 2, -1, -1):
        bucket = F.when(F.col(length) <= steps[i], i).otherwise(bucket)
    placed = numbered(rows.withColumn("bucket", bucket), order, "__place", ["bucket"])
    return placed.withColumn("batch", F.floor(F.col("__place") / size)).drop("__place")


def joined_batches(rows: DataFrame, order: list[str], prompt: str, size: int, separator: str = "\n<<<SEP>>>\n") -> DataFrame:
    """``batch``, ``n``, ``prompts``: so many prompts in ``order`` joined by a separator, for one call of a model."""
    placed = numbered(rows, order, "__place").withColumn("batch", F.floor(F.col("__place") / size))
    got = placed.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("__place", F.col(prompt).alias("p")))).alias("ps"))
    return got.select("batch", F.size("ps").alias("n"), F.array_join(F.transform("ps", lambda x: F.coalesce(x["p"], F.lit(""))), separator).alias("prompts"))


def split_answer(answer: Column, expected: Column, separator: str = "<<<SEP>>>") -> Column:
    """The parts of a batch's answer, trimmed, or null unless there are as many as were asked for."""
    parts = F.transform(F.split(answer, "\\Q" + separator + "\\E"), text.trimmed)
    return F.when(F.size(parts) == expected, parts)


def batched_calls(rows: DataFrame, order: list[str], prompt: str, size: int, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], separator: str = "<<<SEP>>>") -> DataFrame:
    """``rows`` with the model's ``answer``: prompts go in batches; where an answer has another number of parts, all of its
    batch are null. ``model`` takes and returns frames with ``batch``, ``n``, ``prompts`` and adds ``answer``."""
    placed = numbered(rows, order, "__place").withColumn("__batch", F.floor(F.col("__place") / size))
    calls = joined_batches(rows, order, prompt, size, f"\n{separator}\n").mapInPandas(model, "batch long, n int, prompts string, answer string")
    parts = calls.select(F.col("batch").alias("__batch"), F.posexplode(split_answer(F.col("answer"), F.col("n"), separator)).alias("k", "answer"))
    return placed.join(parts.select((F.col("__batch") * size + F.col("k")).alias("__place"), "answer"), "__place", "left").drop("__place", "__batch")


# --- prompt suites --------------------------------------------------------------------------------------

# Words of generated prompts.
_NUMBERS = "zero one two three four five six seven eight nine ten".split()
_POSITIONS = ("left of", "right of", "above", "below")
_COLOURS = "red orange yellow green blue purple pink brown black white".split()


def prompt_suite(classes: DataFrame, name: str, n: int, key: str = "suite", person: str = "person") -> DataFrame:
    """``tag``, ``include``, ``exclude``, ``prompt``: single, two, counted, coloured, placed and two coloured objects.

    Every class has one single-object prompt; of the other kinds ``n`` are drawn by hashed chance, and those that are drawn
    twice are one. Persons have no colours. Classes are numbered by name; a draw picks numbers, which are joined to names,
    so nothing is gathered.
    """
    spark = classes.sparkSession
    own = numbered(classes.select(F.col(name).alias("class")).distinct(), ["class"], "at")
    total = own.count()
    plain = numbered(own.where(F.col("class") != person).select("class"), ["class"], "at")
    bare = plain.count()
    u = lambda what, tag: uniform(F.concat_ws("|", F.lit(key), F.lit(tag), F.col("id").cast("string"), F.lit(what)))
    pick = lambda what, tag, m: F.least(F.floor(u(what, tag) * m), F.lit(m - 1))
    word = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))

    def two(tag: str, m: int, table: DataFrame) -> DataFrame:
        """Draws with two different classes ``a`` and ``b``."""
        first, second = pick("a", tag, m), pick("b", tag, m - 1)
        drawn = spark.range(n).select("id", first.alias("i"), F.when(second >= first, second + 1).otherwise(second).alias("j"))
        return drawn.join(table.select(F.col("at").alias("i"), F.col("class").alias("a")), "i").join(table.select(F.col("at").alias("j"), F.col("class").alias("b")), "j")

    def one(tag: str, m: int, table: DataFrame) -> DataFrame:
        return spark.range(n).select("id", pick("a", tag, m).alias("i")).join(table.select(F.col("at").alias("i"), F.col("class").alias("a")), "i")

    wish = lambda c, count=1, colour=None, relation=None: F.struct(c.alias("class"), F.lit(count).cast("int").alias("count") if not isinstance(count, Column) else count.cast("int").alias("count"), (colour if colour is not None else F.lit(None).cast("string")).alias("color"), (relation if relation is not None else F.lit(None).cast("string")).alias("relation"), F.lit(0 if relation is not None else None).cast("int").alias("target"))
    none = F.filter(F.array(wish(F.lit(""))), lambda w: F.lit(False))
    a, b, photo = F.col("a"), F.col("b"), F.lit("a photo of ")
    article = text.with_article
    parts = [own.select(F.lit("single_object").alias("tag"), F.array(wish(F.col("class"))).alias("include"), none.alias("exclude"), F.concat(photo, article(F.col("class"))).alias("prompt"))]
    if n and total > 1:
        parts.append(two("two_object", total, own).select(F.lit("two_object").alias("tag"), F.array(wish(a), wish(b)).alias("include"), none.alias("exclude"), F.concat(photo, article(a), F.lit(" and "), article(b)).alias("prompt")))
        p = word(_POSITIONS, pick("position", "position", 4))
        parts.append(two("position", total, own).select(F.lit("position").alias("tag"), F.array(wish(b), wish(a, 1, None, p)).alias("include"), none.alias("exclude"), F.concat(photo, article(a), F.lit(" "), p, F.lit(" "), article(b)).alias("prompt")))
    if n and total:
        count = pick("count", "counting", 3) + 2
        parts.append(one("counting", total, own).select(F.lit("counting").alias("tag"), F.array(wish(a, count)).alias("include"), F.array(wish(a, count + 1)).alias("exclude"), F.concat(photo, word(_NUMBERS, count), F.lit(" "), text.plural(a)).alias("prompt")))
    if n and bare:
        c = word(_COLOURS, pick("colour", "colors", 10))
        parts.append(one("colors", bare, plain).select(F.lit("colors").alias("tag"), F.array(wish(a, 1, c)).alias("include"), none.alias("exclude"), F.concat(photo, article(c), F.lit(" "), a).alias("prompt")))
    if n and bare > 1:
        i, j = pick("c", "color_attr", 10), pick("d", "color_attr", 9)
        c, d = word(_COLOURS, i), word(_COLOURS, F.when(j >= i, j + 1).otherwise(j))
        parts.append(two("color_attr", bare, plain).select(F.lit("color_attr").alias("tag"), F.array(wish(a, 1, c), wish(b, 1, d)).alias("include"), none.alias("exclude"), F.concat(photo, article(c), F.lit(" "), a, F.lit(" and "), article(d), F.lit(" "), b).alias("prompt")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()


# --- seeds over files -----------------------------------------------------------------------------------


def repeated(files: DataFrame, order: str, wanted: int, reverse: bool = False) -> DataFrame:
    """``order`` and ``place``: a list of files repeated in turn until there are ``wanted``, backwards if ``reverse``."""
    own = numbered(files.select(order).distinct(), [order], "__at")
    n = own.count()
    if not n:
        return own.select(order, F.col("__at").alias("place"))
    turns = -(-wanted // n)
    each = own.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(max(turns, 1) - 1)))).withColumn("place", F.col("__turn") * n + F.col("__at")).where(F.col("place") < wanted)
    place = F.lit(wanted - 1) - F.col("place") if reverse else F.col("place")
    return each.select(order, place.cast("long").alias("place"))


def token_offsets(rows: DataFrame, order: list[str], tokens: str) -> DataFrame:
    """``rows`` with where their tokens begin in the whole stream."""
    return running_sum(rows, order, F.col(tokens), "__end").withColumn("begin", F.col("__end") - F.col(tokens)).drop("__end")
