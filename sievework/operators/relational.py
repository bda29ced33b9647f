"""Joins, duplicates, order, series and roll-ups of caption and benchmark records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import checkpointed


# --- duplicates, resuming, shards ---------------------------------------------------------------------


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in an explicit order, which must be total for a stable result."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*([c.desc() for c in by] if last else by))
    return rows.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def distinct_content(rows: DataFrame, content: list[str], order: list[str]) -> DataFrame:
    """One row for each serialised content, the first in ``order``."""
    hashed = rows.withColumn("__content", F.sha2(F.to_json(F.struct(*content)), 256))
    return first_of(hashed, ["__content"], order).drop("__content")


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that are not done yet."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def shard_plan(tasks: DataFrame, index: str, shard_size: int, world: int, rank: int, done_shards: DataFrame | None = None) -> DataFrame:
    """This node's tasks with ``shard_id``, without shards that are done."""
    plan = tasks.withColumn("shard_id", F.floor(F.col(index) / shard_size)).where(F.pmod("shard_id", F.lit(world)) == rank)
    return plan if done_shards is None else plan.join(done_shards.select("shard_id").distinct(), "shard_id", "left_anti")


# --- joins ----------------------------------------------------------------------------------------------


def with_misses(left: DataFrame, right: DataFrame, keys: list[str], mark: str = "found") -> DataFrame:
    """A left join that says which rows had a partner, for counting misses by reason."""
    return left.join(right.withColumn(mark, F.lit(True)), keys, "left").withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))


def agreeing(judgements: DataFrame, key: str, judge: str, choice: str, judges: int) -> DataFrame:
    """Keys that all ``judges`` judged, with one and the same choice."""
    return judgements.groupBy(key).agg(F.countDistinct(judge).alias("__j"), F.min(choice).alias(choice), F.max(choice).alias("__hi")).where(
        (F.col("__j") == judges) & (F.col(choice) == F.col("__hi"))
    ).select(key, choice)


def unordered_pairs(rows: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """The pairs of each group's candidates, which are a handful by design."""
    r = rows.select(group, item, value)
    a = r.select(group, F.col(item).alias("a"), F.col(value).alias("a_value"))
    b = r.select(group, F.col(item).alias("b"), F.col(value).alias("b_value"))
    return a.join(b, group).where("a < b")


# --- series ---------------------------------------------------------------------------------------------


def trajectory(rows: DataFrame, run: str, file: str, step: str, tokens: str, loss: str) -> DataFrame:
    """``cum`` tokens in order of file and step, and the last known ``loss``, which begins anew in each file.

    Only positive tokens count. Rows without a step are left out, and rows before the first tokens or loss.
    """
    known = rows.where(F.col(step).isNotNull())
    order = Window.partitionBy(run).orderBy(file, step)
    in_file = Window.partitionBy(run, file).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(F.when(F.col(tokens) > 0, F.col(tokens)).otherwise(0.0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = known.select(run, file, step, cum.alias("cum"), F.last(loss, ignorenulls=True).over(in_file).alias("loss"))
    return out.where((F.col("cum") > 0) & F.col("loss").isNotNull())


def unified_budget(series: DataFrame, run: str) -> DataFrame:
    """One row: the least of all runs' final token counts."""
    return series.groupBy(run).agg(F.max("cum").alias("last")).agg(F.min("last").alias("budget"))


def smoothed_at(series: DataFrame, run: str, budget: Column | float, window: float = 0.02) -> DataFrame:
    """Each run's upper median of losses within a share of the budget; runs without any are left out."""
    from sievework.functions.stats import upper_median

    b = budget if isinstance(budget, Column) else F.lit(budget)
    near = series.where(F.col("cum").between(b * (1 - window), b * (1 + window)))
    return near.groupBy(run).agg(F.collect_list("loss").alias("xs")).select(run, upper_median(F.col("xs")).alias("loss"))


def islands(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Runs of consecutive whole numbers: first, last and length."""
    d = rows.select(group, F.col(value).alias("v")).distinct()
    k = d.withColumn("k", F.col("v") - F.row_number().over(Window.partitionBy(group).orderBy("v")))
    return k.groupBy(group, "k").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count(F.lit(1)).alias("length")).drop("k")


def offsets(rows: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """Where each row's stretch begins and ends when they are laid end to end."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(length).over(w)
    return rows.select("*", (end - F.col(length)).alias("begin"), end.alias("end"))


# --- roll-ups -------------------------------------------------------------------------------------------


def micro_macro(rows: DataFrame, group: str, correct: Column) -> DataFrame:
    """One row: the share of correct rows, and the mean of groups' shares."""
    g = rows.groupBy(group).agg(F.sum(correct.cast("int")).alias("c"), F.count(F.lit(1)).alias("n"))
    return g.agg((F.sum("c") / F.sum("n")).alias("micro"), F.avg(F.col("c") / F.col("n")).alias("macro"), F.count(F.lit(1)).alias("groups"))


def two_levels(rows: DataFrame, upper: Column, lower: Column, value: str) -> DataFrame:
    """Means by both levels, by the upper one and over all, as a rollup."""
    return rows.select(upper.alias("l1"), lower.alias("l2"), F.col(value).alias("v")).rollup("l1", "l2").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def weighted_overall(means: DataFrame, group: str, mean: str, weights: dict[str, float]) -> DataFrame:
    """One row: the weighted sum of group means; null unless every group is there."""
    w = means.sparkSession.createDataFrame(list(weights.items()), f"{group} string, w double")
    joined = w.join(means.select(group, F.col(mean).alias("m")), group, "left")
    return joined.agg(F.when(F.count("m") == len(weights), F.sum(F.col("w") * F.col("m"))).alias("overall"))


def wiscore(consistency: Column, realism: Column, aesthetic: Column) -> Column:
    return (0.7 * consistency + 0.2 * realism + 0.1 * aesthetic) / 2


def missing_ids(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Whole numbers of a range that are no key."""
    return rows.sparkSession.range(first, last + 1).withColumnRenamed("id", key).join(rows.select(key).distinct(), key, "left_anti")


def exam_scores(points: Column, answers: Column, spelling: Column, readability: Column, logic: Column) -> Column:
    """Semantic, strict and relaxed score from points with scores and 0/1 answers, halves to even."""
    pairs = F.arrays_zip(points.alias("p"), answers.alias("a"))
    got = F.bround(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.when(x["a"] == 1, x["p"]).otherwise(0.0)), 4)
    strict = F.forall(answers, lambda a: a == 1) & (spelling == 2) & (readability == 2) & (logic == 2)
    relaxed = F.bround(got * 0.7 + spelling * 0.1 / 2 + readability * 0.1 / 2 + logic * 0.1 / 2, 3)
    return F.struct(got.alias("semantic"), strict.cast("int").alias("strict"), relaxed.alias("relaxed"))


def geometric_mean(value: Column) -> Column:
    """An aggregate; 0 as soon as a value is 0."""
    return F.when(F.min(value) <= 0, 0.0).otherwise(F.exp(F.avg(F.when(value > 0, F.ln(value)))))


def text_score(edits: Column, complete: Column, matched: Column, total: Column, most: int) -> Column:
    """An aggregate: mean edits and completeness, and matched words over all words."""
    rate = F.coalesce(F.try_divide(F.sum(matched), F.sum(total)), F.lit(0.0))
    return 1 - F.least(F.lit(float(most)), F.avg(edits)) * (1 - F.avg(complete)) * (1 - rate) / most


def zero_dependents(rows: DataFrame, item: str, question: str, parents: str, score: str) -> DataFrame:
    """Scores set to 0 where a parent's raw score is 0; parents that are missing do not count."""
    asked = rows.select(item, question, F.explode(parents).alias("__p"))
    raw = rows.select(item, F.col(question).alias("__p"), F.col(score).alias("__s"))
    low = asked.join(raw, [item, "__p"]).groupBy(item, question).agg(F.min("__s").alias("__low"))
    return rows.join(low, [item, question], "left").withColumn(score, F.when(F.col("__low") == 0, 0.0).otherwise(F.col(score))).drop("__low")


def zero_dependents_in_order(questions: Column) -> Column:
    """The same within one item's array of (question, parents, score), each in turn seeing earlier zeros.

    Parent 0 is the root. A parent that comes later still has its raw score. An item has a few questions.
    """
    def step(done: Column, q: Column) -> Column:
        def of(p: Column) -> Column:
            known = F.filter(done, lambda d: d["question"] == p)
            raw = F.filter(questions, lambda d: d["question"] == p)
            return F.coalesce(F.get(known, F.lit(0))["score"], F.get(raw, F.lit(0))["score"], F.lit(1.0))

        zero = F.exists(q["parents"], lambda p: (p != 0) & (of(p) == 0))
        return F.concat(done, F.array(F.struct(q["question"].alias("question"), F.when(zero, F.lit(0.0)).otherwise(q["score"]).alias("score"))))

    return F.aggregate(questions, F.expr("cast(array() as array<struct<question:int,score:double>>)"), step)


def style_score(rows: DataFrame, references: DataFrame, key: list[str], vector: str, style: str) -> DataFrame:
    """Each row's greatest cosine-like product with its style's reference vectors, at least 0.

    Reference vectors are a fixed few for each style.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    refs = references.groupBy(style).agg(F.collect_list(vector).alias("__refs"))
    return rows.join(refs, style).select(*key, style, F.greatest(F.lit(0.0), F.array_max(F.transform("__refs", lambda r: dot(F.col(vector), r)))).alias("score"))


def style_score_of_many(rows: DataFrame, references: DataFrame, key: list[str], vector: str, style: str) -> DataFrame:
    """As :func:`style_score` for any number of references, 0 where a style has none; ``key`` and ``style`` name a row.

    Exact, by bounds. Equal vectors of a style are compared once. A vector e that is among the references has a product
    of e.e at least, else 0 is the least; a reference r has a greater one than b only if |e - r|^2 < |e|^2 + |r|^2 - 2 b,
    which the longest reference bounds, so that only those within this distance in each of the first three components
    are multiplied. They meet in cells of eight times the style's largest distance. Where lengths are alike, as those of
    unit vectors are, few are left; where they are not, or a vector is in no reference, up to all of the style are.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    both = references.select(F.col(style).alias("s"), F.col(vector).cast("array<double>").alias("v"), F.lit(True).alias("ref"), F.lit(False).alias("row")).unionByName(
        rows.select(F.col(style).alias("s"), F.col(vector).cast("array<double>").alias("v"), F.lit(False).alias("ref"), F.lit(True).alias("row")))
    each = both.where("s IS NOT NULL AND v IS NOT NULL").groupBy("s", "v").agg(F.max("ref").alias("ref"), F.max("row").alias("row"))
    place = [F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)).alias(f"x{i}") for i in range(3)]
    each = checkpointed(each.select("*", dot(F.col("v"), F.col("v")).alias("nn"), *place, F.monotonically_increasing_id().alias("node")))
    least = F.when(F.col("ref"), F.col("nn")).otherwise(0.0)
    longest = each.where("ref").groupBy("s").agg(F.max("nn").alias("longest"))
    # a billionth more than the bound covers the rounding of sums
    reach = F.sqrt(F.greatest(F.col("nn") + F.col("longest") - 2 * least, F.lit(0.0)) + 1e-9 * (F.col("nn") + F.col("longest")) + 1e-300)
    asked = checkpointed(each.where("row").join(longest, "s").select("s", "node", "v", "x0", "x1", "x2", least.alias("least"), reach.alias("reach")).where("reach IS NOT NULL"))
    width = asked.groupBy("s").agg((8 * F.max("reach")).alias("width"))

    def cell(x):
        # no cells where lengths have no bound: all of the style meet
        return F.when(F.col("width") < 1e150, F.floor(x / F.col("width"))).otherwise(F.lit(0).cast("long"))

    a = asked.join(width, "s")
    for i in range(3):
        a = a.withColumn(f"c{i}", F.explode(F.sequence(cell(F.col(f"x{i}") - F.col("reach")), cell(F.col(f"x{i}") + F.col("reach")))))
    b = each.where("ref AND nn IS NOT NULL").join(width, "s").select("s", *[cell(F.col(f"x{i}")).alias(f"c{i}") for i in range(3)], F.col("v").alias("r"), F.col("node").alias("other"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(3)])
    met = a.join(b, ["s", "c0", "c1", "c2"]).where("node <> other")
    for i in range(3):
        met = met.where((F.abs(F.col(f"x{i}") - F.col(f"y{i}")) <= F.col("reach")) | ~(F.col("reach") < 1e150))
    best = met.select("node", dot(F.col("v"), F.col("r")).alias("p")).unionByName(asked.select("node", F.col("least").alias("p"))).groupBy("node").agg(F.max("p").alias("best"))
    found = each.where("row").join(best, "node").select("s", "v", "best")
    named = rows.select(*key, style, F.col(vector).cast("array<double>").alias("__v")).join(found.select(F.col("s").alias(style), F.col("v").alias("__v"), F.col("best").alias("__best")), [style, "__v"], "left")
    return named.groupBy(*key, style).agg(F.greatest(F.lit(0.0), F.max("__best")).alias("score"))


def loss_histogram(rows: DataFrame, time: str, loss: str, width: int = 100, buckets: int = 10) -> DataFrame:
    """Sums and counts of losses in half-open buckets of time; times outside are left out."""
    b = F.floor(F.col(time) / width)
    return rows.where((F.col(time) >= 0) & (F.col(time) < width * buckets)).groupBy(b.alias("bucket")).agg(F.sum(loss).alias("total"), F.count(loss).alias("n"), F.avg(loss).alias("mean"))


# --- ranking --------------------------------------------------------------------------------------------


def symmetric(forward: Column, reverse: Column) -> Column:
    """One preference from both orders of a comparison; a missing one counts as undecided."""
    return (F.coalesce(forward, F.lit(0.5)) + 1 - F.coalesce(reverse, F.lit(0.5))) / 2


def winner(y: Column) -> Column:
    return F.when(y > 0.5, "A").when(y < 0.5, "B").otherwise("TIE")


def ranked(rows: DataFrame, group: str, rating: str, valid: str, position: str) -> DataFrame:
    """Candidates by falling rating; ties in given order, invalid ones last with a rating of minus infinity."""
    r = F.when(F.col(valid), F.col(rating)).otherwise(F.lit(float("-inf")))
    w = Window.partitionBy(group).orderBy(F.col("rating").desc(), F.col(valid).desc(), F.col(position))
    return rows.withColumn("rating", r).withColumn("rank", F.row_number().over(w))


def top_k(rows: DataFrame, keys: list[str], score: Column, ties: list[str], k: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(score.desc(), *[F.col(t) for t in ties])
    return rows.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= k).drop("__place")


def completed(images: DataFrame, index: str, image: str, ok: Column, expected: int) -> DataFrame:
    """Indices all of whose ``expected`` images have ended, well or not, with at least two good ones."""
    one = images.groupBy(index, image).agg(F.max(ok.cast("int")).alias("ok"))
    return one.groupBy(index).agg(F.count(F.lit(1)).alias("n_done"), F.sum("ok").alias("n_valid")).where(
        (F.col("n_done") >= expected) & (F.col("n_valid") >= 2)
    )


def verification_summary(facets: dict[str, tuple[Column, Column]]) -> Column:
    """Mean score and whether all pass, over facets that have a score; both null without any."""
    scores = F.array_compact(F.array(*[s for s, _ in facets.values()]))
    passes = F.array_compact(F.array(*[F.when(s.isNotNull(), F.coalesce(p, F.lit(False))) for s, p in facets.values()]))
    n = F.size(scores)
    return F.struct(
        F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), n).alias("overall_score"),
        F.when(n > 0, F.forall(passes, lambda p: p)).alias("overall_pass"),
    )
