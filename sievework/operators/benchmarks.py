"""Roll-ups of benchmark answers: exams, skills, checklists, hierarchies, detections and judge summaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators import documents
from sievework.operators.statistics import running_sum, saturation_by

# --- joins ----------------------------------------------------------------------------------------------


def cells_with_losses(cells: DataFrame, losses: DataFrame, runs: DataFrame, excluded: list[str], kind: str = "kind", level: str = "level", run: str = "run") -> DataFrame:
    """``cells`` beside the loss of their run: ``runs`` says which run a kind and level is; excluded runs go.

    ``runs`` is a dimension of a few dozen rows. Cells without a run, and runs without a loss, are left out.
    """
    known = runs.where(~F.col(run).isin(*excluded)) if excluded else runs
    return cells.join(known, [kind, level]).join(losses, run)


def shard_lookup(keys: DataFrame, records: DataFrame, index: str, shard_size: int, also: list[str] | None = None) -> DataFrame:
    """Records of the wanted keys, by a join on their shard and key, so that records partitioned by ``shard_id`` are pruned."""
    want = keys.select(index, *(also or [])).distinct().withColumn("shard_id", F.floor(F.col(index) / shard_size))
    have = records if "shard_id" in records.columns else records.withColumn("shard_id", F.floor(F.col(index) / shard_size))
    return have.join(want, ["shard_id", index, *(also or [])])


def zipped(scores: DataFrame, names: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """``key``, ``place``, ``name``, ``score``: two arrays of a key side by side; what the longer has more is left out."""
    n = F.least(F.size(score), F.size(name))
    both = scores.join(names, key).select(key, F.slice(F.arrays_zip(score, name), 1, n).alias("both"))
    return both.select(key, F.posexplode("both").alias("place", "x")).select(key, "place", F.col(f"x.{name}").alias(name), F.col(f"x.{score}").alias(score))


def range_category(value: Column, ranges: list[tuple[int, int, str]]) -> Column:
    """The name of the range, both ends included, that a number is in; null for none."""
    return reduce(lambda c, r: c.when(value.between(r[0], r[1]), r[2]), ranges, F.when(F.lit(False), ""))


#: Numbers of prompts by category.
WORLD_RANGES = [(1, 400, "CULTURE"), (401, 567, "TIME"), (568, 700, "SPACE"), (701, 800, "BIOLOGY"), (801, 900, "PHYSICS"), (901, 1000, "CHEMISTRY")]


# --- roll-ups -------------------------------------------------------------------------------------------


def any_correct(rows: DataFrame, prompt: str, correct: str) -> DataFrame:
    """One row: the share of correct images, the share of prompts with any, and the number of both."""
    one = rows.groupBy(prompt).agg(F.max(F.col(correct).cast("int")).alias("any"), F.sum(F.col(correct).cast("int")).alias("c"), F.count(F.lit(1)).alias("n"))
    return one.agg((F.sum("c") / F.sum("n")).alias("images"), F.avg("any").alias("prompts"), F.sum("n").alias("n_images"), F.count(F.lit(1)).alias("n_prompts"))


def exam_rollup(scores: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    """Means and counts by subject and, with a null subject, over all rows; rows without a subject are under ``all``."""
    named = scores.withColumn(subject, F.coalesce(F.col(subject), F.lit("all")))
    return named.rollup(subject).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


#: The skills that a question can ask for.
SKILLS = ("object", "attribute", "count", "position", "verb")


def skill_means(rows: DataFrame, skill: str, score: str, skills: tuple[str, ...] = SKILLS) -> DataFrame:
    """Mean score in percent and count by skill; an unknown skill is an error, as its score would be lost."""
    known = F.when(F.col(skill).isin(*skills), F.col(skill)).otherwise(F.raise_error(F.concat(F.lit("unknown skill: "), F.coalesce(F.col(skill), F.lit("null")))))
    return rows.select(known.alias(skill), F.col(score).alias("__s")).groupBy(skill).agg((100 * F.avg("__s")).alias("mean"), F.count("__s").alias("n"))


def yes_no_score(answer: Column) -> Column:
    """1 for an answer with the word yes, 0 for one with no, null for others; yes goes first."""
    return F.when(answer.rlike(r"\byes\b"), 1.0).when(answer.rlike(r"\bno\b"), 0.0)


def checklist_mean(rows: DataFrame, item: str, score: Column) -> DataFrame:
    """One row: the mean of items' mean scores; null scores don't count, nor items without any."""
    each = rows.groupBy(item).agg(F.avg(score).alias("m"))
    return each.agg(F.avg("m").alias("mean"), F.count("m").alias("items"))


def accuracy_table(rows: DataFrame, row: list[str], column: str, columns: list[str], correct: Column) -> DataFrame:
    """Accuracy by ``row`` with a column for each of ``columns``, and ``mean`` over those that a row has."""
    wide = rows.groupBy(*row).pivot(column, columns).agg(F.avg(correct.cast("double")))
    have = F.array_compact(F.array(*[F.col(f"`{c}`") for c in columns]))
    return wide.withColumn("mean", F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, x: a + x), F.size(have)))


def hierarchy_means(scores: DataFrame, hierarchy: DataFrame, attribute: str, group: str, score: str) -> DataFrame:
    """``group``, ``mean`` of its attributes' means, and a last row (null group) with the mean of the groups.

    ``hierarchy`` (``attribute``, ``group``) is a dimension of a few dozen rows; attributes outside it are left out.
    """
    attributes = scores.groupBy(attribute).agg(F.avg(score).alias("a")).join(hierarchy.select(attribute, group).distinct(), attribute)
    groups = attributes.groupBy(group).agg(F.avg("a").alias("mean"), F.count(F.lit(1)).alias("attributes"))
    return groups.unionByName(groups.agg(F.lit(None).cast(dict(groups.dtypes)[group]).alias(group), F.avg("mean").alias("mean"), F.sum("attributes").alias("attributes")))


def pair_diversity(pairs: DataFrame, prompt: list[str], kind: str, distance: str) -> DataFrame:
    """``kind``, ``mean``, ``n``: prompts' mean distance of pairs, averaged by class; with a null class, over all prompts.

    A prompt with a single picture has no pair and no score.
    """
    each = pairs.groupBy(kind, *prompt).agg(F.avg(distance).alias("d")).where("d IS NOT NULL")
    return each.rollup(kind).agg(F.avg("d").alias("mean"), F.count(F.lit(1)).alias("n"))


def conditional_means(scores: DataFrame, facts: DataFrame, keys: list[str], score: str, conditions: dict[str, Column]) -> DataFrame:
    """One row: for every condition over the facts of a prompt, the mean score (``name``) and the count (``n_name``).

    A condition that no prompt meets has a null mean. All are aggregated in one pass.
    """
    joined = scores.join(facts, keys)
    return joined.agg(*[a for name, c in conditions.items() for a in (F.avg(F.when(c, F.col(score))).alias(name), F.count(F.when(c, F.col(score))).alias(f"n_{name}"))])


def mean_similarity(rows: DataFrame, keys: list[str], similarity: str) -> DataFrame:
    """Mean similarity and count by ``keys``; answers without a similarity are left out."""
    return rows.groupBy(*keys).agg(F.avg(similarity).alias("mean"), F.count(similarity).alias("n"))


def judge_summary(points: DataFrame, judge: str, name: str, x: str, y: str, least: int = 6, near: float = 0.5, top: str = "st_l10", full: str = "full", other: str = "no_bbox") -> DataFrame:
    """For every judge with at least ``least`` points: ends of x and y, the line, whether ``top`` has the greatest x
    (within ``near``), how much more ``other`` has than ``full``, and floor and R2 of the saturation fit."""
    ok = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = lambda n: F.first(F.when(F.col(name) == n, F.col(x)), ignorenulls=True)
    dx, dy = F.var_pop(x), F.var_pop(y)
    s = ok.groupBy(judge).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"),
        at(top).alias("x_top"), (at(other) - at(full)).alias("direction"), F.covar_pop(x, y).alias("__c"), dx.alias("__vx"), dy.alias("__vy"), F.avg(x).alias("__mx"), F.avg(y).alias("__my"),
    ).where(F.col("n") >= least)
    flat = (F.col("__vx") > 0) & (F.col("__vy") > 0)
    slope = F.when(flat, F.try_divide("__c", "__vx")).otherwise(0.0)
    r = F.when(flat, F.try_divide(F.col("__c"), F.sqrt(F.col("__vx") * F.col("__vy")))).otherwise(0.0)
    lines = s.select(judge, "n", "x_min", "x_max", "y_min", "y_max", "x_top", F.coalesce(F.abs(F.col("x_top") - F.col("x_max")) < near, F.lit(False)).alias("top_is_greatest"), "direction",
                     slope.alias("slope"), (F.col("__my") - slope * F.col("__mx")).alias("intercept"), r.alias("r"), (r * r).alias("r2"))
    # a judge's points are a handful
    fits = saturation_by(ok, [judge], x, y).select(judge, F.col("floor").alias("saturation_floor"), F.col("r2").alias("saturation_r2"))
    return lines.join(fits, judge, "left")


def counters(rows: DataFrame, index: str, mode: str, score: str) -> DataFrame:
    """``counter``, ``name``, ``n``: rows by mode, distinct indices, and scores rounded to one decimal, halves to even."""
    n = F.count(F.lit(1)).alias("n")
    modes = rows.groupBy(F.lit("mode").alias("counter"), F.col(mode).cast("string").alias("name")).agg(n)
    scores = rows.where(F.col(score).isNotNull()).groupBy(F.lit("score").alias("counter"), F.format_string("%.1f", F.bround(F.col(score).cast("double"), 1)).alias("name")).agg(n)
    indices = rows.agg(F.lit("indices").alias("counter"), F.lit(None).cast("string").alias("name"), F.countDistinct(index).alias("n"))
    return modes.unionByName(scores).unionByName(indices)


def question_counts(rows: DataFrame, keys: list[str], questions: str) -> DataFrame:
    """Questions and rows by ``keys``; a missing list has none."""
    return rows.groupBy(*keys).agg(F.sum(F.greatest(F.size(questions), F.lit(0))).cast("long").alias("questions"), F.count(F.lit(1)).alias("rows"))


def reduced(parts: DataFrame, keys: list[str], total: str, count: str, seen: str | None = None) -> DataFrame:
    """Means of sums and counts that workers handed in, and (``seen``) the counts accumulated over the rounds before."""
    one = parts.groupBy(*keys).agg(F.sum(total).alias("total"), F.sum(count).alias("n")).withColumn("mean", F.try_divide("total", "n"))
    return running_sum(one, [seen], F.col("n"), "n_so_far", [k for k in keys if k != seen]) if seen else one


# --- detections -----------------------------------------------------------------------------------------

#: Colours in the order in which they are told.
COLOURS = ("red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "black", "white")


def kept_detections(boxes: list[tuple], threshold: float, most: int, overlap: float) -> list[tuple]:
    """Boxes (x1, y1, x2, y2, score, colour) of one class above a score, the first ``most``, without overlapping ones.

    They come best first; ``overlap`` of 1 or more keeps all.
    """
    some = [b for b in boxes if b[4] > threshold][:most]
    if overlap >= 1:
        return some
    return [some[i] for i in documents.non_maximum([b[:4] for b in some], list(range(len(some), 0, -1)), overlap, strict=True)]


def place_names(a: tuple, b: tuple, dead_zone: float = 0.1) -> list[str]:
    """Where box ``a`` lies from box ``b``, after a dead zone of both boxes' sizes; boxes include their last pixel."""
    middle = lambda q, i: (q[i] + q[i + 2]) / 2
    rest = []
    for i in (0, 1):
        off = middle(a, i) - middle(b, i)
        spread = dead_zone * (abs(a[i + 2] - a[i]) + abs(b[i + 2] - b[i]))
        rest.append(max(abs(off) - spread, 0.0) * (1 if off > 0 else -1))
    if all(abs(v) < 1e-3 for v in rest):
        return []
    # the direction is that of the offsets left over, as a share of the whole offset
    length = ((middle(a, 0) - middle(b, 0)) ** 2 + (middle(a, 1) - middle(b, 1)) ** 2) ** 0.5
    dx, dy = (v / length for v in rest)
    return [n for n, on in (("left of", dx < -0.5), ("right of", dx > 0.5), ("above", dy < -0.5), ("below", dy > 0.5)) if on]


def spec_result(objects: dict[str, list[tuple]], include: list[dict], exclude: list[dict]) -> tuple[bool, str]:
    """Whether a picture's objects are as asked for, and why not, line by line.

    Every wish of ``include`` (class, count, colour, position as (relation, number of an earlier wish)) must be met;
    an ``exclude`` (class, count) forbids so many. A position is looked at only where class and colour are right, and
    holds if every object found has it to every object of the other wish.
    """
    reasons: list[str] = []
    groups: list[list[tuple] | None] = []
    for wish in include:
        name, count = wish["class"], wish["count"]
        found = objects.get(name, [])[:count]
        why = None
        if len(found) < count:
            why = f"expected {name}>={count}, found {len(found)}"
        else:
            colour = wish.get("color")
            seen = [f[5] for f in found]
            if colour and seen.count(colour) < count:
                others = ", ".join(f"{seen.count(c)} {c}" for c in COLOURS if c in seen)
                why = f"expected {colour} {name}>={count}, found {seen.count(colour)} {colour}; and {others}"
            elif wish.get("position"):
                relation, target = wish["position"]
                if groups[target] is None:
                    why = f"no target for {name} to be {relation}"
                else:
                    pairs = ((o, t) for o in found for t in groups[target])
                    wrong = next((p for o, t in pairs if relation not in (p := place_names(o, t))), None)
                    why = None if wrong is None else f"expected {name} {relation} target, found {' and '.join(wrong)} target"
        if why:
            reasons.append(why)
        groups.append(None if why else found)
    for wish in exclude:
        if len(found := objects.get(wish["class"], [])) >= wish["count"]:
            reasons.append(f"expected {wish['class']}<{wish['count']}, found {len(found)}")
    return not reasons, "\n".join(reasons)


_BOX = "struct<x1:double,y1:double,x2:double,y2:double,score:double,colour:string>"
#: Columns of a picture's detections and of the wishes that its prompt makes.
DETECTIONS = f"map<string,array<{_BOX}>>"
WISHES = "array<struct<class:string,count:int,color:string,relation:string,target:int>>"


def evaluated(
    rows: DataFrame, key: list[str], detections: str, include: str, exclude: str, tag: str, threshold: float = 0.3,
    counting_threshold: float = 0.9, most: int = 16, overlap: float = 1.0,
) -> DataFrame:
    """``key``, ``tag``, ``correct``, ``reason`` of pictures: detections above the tag's threshold, without overlapping
    ones, against the wishes of their prompt. Columns have the types DETECTIONS and WISHES; a row is a picture."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for found, yes, no, name in zip(pdf[detections], pdf[include], pdf[exclude], pdf[tag], strict=True):
                least = counting_threshold if name == "counting" else threshold
                items = dict(found or {}).items()
                kept = {c: kept_detections([tuple(b.values()) for b in (bs if bs is not None else [])], least, most, overlap) for c, bs in items}
                wishes = [[{"class": w["class"], "count": w["count"], "color": w["color"], "position": (w["relation"], int(w["target"])) if w["relation"] else None} for w in (ws if ws is not None else [])] for ws in (yes, no)]
                out.append(spec_result({c: b for c, b in kept.items() if b}, *wishes))
            yield pd.concat([pdf[[*key, tag]].reset_index(drop=True), pd.DataFrame(out, columns=["correct", "reason"])], axis=1)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*key, tag]) + ", correct boolean, reason string"
    return rows.select(*key, tag, detections, include, exclude).mapInPandas(run, schema)
