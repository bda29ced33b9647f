"""Ranking of candidate pictures by judges, verification of the best, and the export of fine-tuning rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import documents as D
from sievework.operators import relational as R

#: Facets of a verification; the last two are those that count for clean scores.
FACETS = ("thinking", "aesthetic", "structure", "alignment")
SCORED = ("alignment", "structure")

# --- ratings by judge mode ------------------------------------------------------------------------------


def pairwise_ratings(samples: DataFrame, comparisons: DataFrame, index: str, image: str, valid: str, reg: float = 0.01) -> DataFrame:
    """``index``, ``image``, ``valid``, ``rating`` of all samples from comparisons in both orders.

    ``comparisons`` are (index, a, b, y), y being the preference for a; a pair that was judged in both orders has
    two rows, (a, b) and (b, a), and a missing or failed one counts as undecided. Ratings are fitted over the valid
    samples of an index, which are a handful, all of whose pairs count. An index with fewer than two valid samples has
    ratings of 0; else samples that are not valid have minus infinity.
    """
    good = samples.where(F.col(valid)).select(index, F.col(image).cast("long").alias("i"))
    pairs = good.select(index, F.col("i").alias("a")).join(good.select(index, F.col("i").alias("b")), index).where("a < b")
    got = comparisons.select(index, "a", "b", F.col("y").alias("__y"))
    forward, reverse = got.withColumnRenamed("__y", "f"), got.select(index, F.col("a").alias("b"), F.col("b").alias("a"), F.col("__y").alias("r"))
    both = pairs.join(forward, [index, "a", "b"], "left").join(reverse, [index, "a", "b"], "left")
    fitted = D.rate_groups(both.select(index, "a", "b", R.symmetric(F.col("f"), F.col("r")).alias("y")), index, reg=reg)
    n = samples.groupBy(index).agg(F.count_if(valid).alias("__n"))
    rated = samples.select(index, F.col(image).cast("long").alias("item"), F.col(valid).alias("valid")).join(fitted, [index, "item"], "left").join(n, index)
    rating = F.when(F.col("__n") < 2, F.lit(0.0)).when(F.col("valid"), F.coalesce("rating", F.lit(0.0))).otherwise(F.lit(float("-inf")))
    return rated.select(index, F.col("item").alias(image), "valid", rating.alias("rating"), F.col("__n").alias("n_valid"))


def single_ratings(samples: DataFrame, index: str, image: str, valid: str, score: str) -> DataFrame:
    """The same columns from one score for each picture; a valid one without a score has 0, and so have all of an
    index without valid ones."""
    n = F.count_if(F.col(valid)).over(Window.partitionBy(index))
    rating = F.when(n == 0, F.lit(0.0)).when(F.col(valid), F.coalesce(F.col(score).cast("double"), F.lit(0.0))).otherwise(F.lit(float("-inf")))
    return samples.select(index, F.col(image).cast("long").alias(image), F.col(valid).alias("valid"), rating.alias("rating"), n.alias("n_valid"))


def detail_ratings(samples: DataFrame, verdicts: DataFrame, index: str, image: str, valid: str) -> DataFrame:
    """The same columns from the overall score of a verification of each picture (``overall_score``)."""
    return single_ratings(samples.join(verdicts.select(index, image, "overall_score"), [index, image], "left"), index, image, valid, "overall_score")


def ranked_samples(mode: str, samples: DataFrame, answers: DataFrame, index: str = "index", image: str = "image_idx", valid: str = "valid", reg: float = 0.01) -> DataFrame:
    """Ratings by judge mode: ``pairwise`` and ``mix`` from comparisons, ``single`` from scores (index, image, score),
    ``single_detail`` from verifications (index, image, overall_score)."""
    if mode in ("pairwise", "mix"):
        return pairwise_ratings(samples, answers, index, image, valid, reg)
    if mode == "single":
        return single_ratings(samples.join(answers.select(index, image, "score"), [index, image], "left"), index, image, valid, "score")
    if mode == "single_detail":
        return detail_ratings(samples, answers, index, image, valid)
    raise ValueError("mode is one of pairwise, single, mix, single_detail")


def rankings(rated: DataFrame, index: str = "index", image: str = "image_idx") -> DataFrame:
    """One row an index: ``n_samples``, ``n_valid``, ``rankings`` (pictures by falling rating; of equal ones valid before
    others, then in given order), ``ratings`` by picture and ``best_image_idx``. An index has a handful of pictures."""
    order = F.struct((-F.col("rating")).alias("r"), (~F.col("valid")).alias("v"), F.col(image).alias("image"), F.col("rating").alias("rating"))
    got = rated.groupBy(index).agg(F.sort_array(F.collect_list(order)).alias("s"), F.max("n_valid").alias("n_valid"))
    ratings = F.map_from_entries(F.transform("s", lambda x: F.struct(x["image"].cast("string"), F.round(x["rating"], 4))))
    return got.select(index, F.size("s").alias("n_samples"), "n_valid", F.transform("s", lambda x: x["image"]).alias("rankings"), ratings.alias("ratings"), F.get("s", F.lit(0))["image"].alias("best_image_idx"))


# --- verification ---------------------------------------------------------------------------------------


def overall(facets: Column) -> Column:
    """``overall_score`` (mean to four places) and ``overall_pass`` over facets with a score; without any, no score and passed.

    ``facets`` is a map from name to (score, pass). A facet with a score passes only if it says so.
    """
    scored = F.filter(F.map_values(facets), lambda v: v["score"].isNotNull())
    mean = F.try_divide(F.aggregate(scored, F.lit(0.0), lambda a, v: a + v["score"]), F.size(scored))
    return F.struct(F.bround(mean, 4).alias("overall_score"), F.forall(scored, lambda v: F.coalesce(v["pass"], F.lit(False))).alias("overall_pass"))


def two_phase(ranked: DataFrame, verdicts: DataFrame, messages: DataFrame, index: str = "index", image: str = "image_idx", best: str = "best_image_idx") -> DataFrame:
    """Rankings with the verification of their best picture: ``facets``, ``overall_score``, ``overall_pass``.

    ``verdicts`` are (index, image, facet, score, pass), ``messages`` the (index, image) that have any; thinking is not
    verified without them. A best picture without verdicts is verified by nothing: no score, and passed.
    """
    asked = verdicts.join(messages.select(index, image).distinct().withColumn("__has", F.lit(True)), [index, image], "left")
    kept = asked.where((F.col("facet") != "thinking") | F.coalesce("__has", F.lit(False)))
    entry = F.struct(F.col("facet"), F.struct(F.col("score").cast("double").alias("score"), F.col("pass")))
    by_image = kept.groupBy(index, F.col(image).alias(best)).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("facets"))
    none = F.expr("cast(map() as map<string,struct<score:double,pass:boolean>>)")
    joined = ranked.join(by_image, [index, best], "left").withColumn("facets", F.coalesce("facets", none))
    return joined.withColumn("__o", overall(F.col("facets"))).select("*", "__o.overall_score", "__o.overall_pass").drop("__o")


def clean_score(facets: Column, names: tuple[str, ...] = SCORED) -> Column:
    """Mean score of the facets that count; null if none has one."""
    scores = F.array_compact(F.array(*[F.element_at(facets, n)["score"] for n in names]))
    return F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), F.size(scores))


def facets_pass(facets: Column, names: tuple[str, ...] = SCORED) -> Column:
    """True if every facet that counts is there and passes."""
    each = [F.coalesce(F.element_at(facets, n)["pass"], F.lit(False)) for n in names]
    out = each[0]
    for e in each[1:]:
        out = out & e
    return out


# --- export ---------------------------------------------------------------------------------------------


def export_states(
    verified: DataFrame, rollouts: DataFrame, index: str = "index", image: str = "image_idx", best: str = "best_image_idx", least_score: float = 0.0,
    floors: dict[str, float] | None = None, require_pass: bool = False, require_facets: bool = False, most_waits: int = 0, most_length: int = 0,
) -> DataFrame:
    """Every verified ranking with ``state``: the first gate that stops it, or ``written``; and ``messages``, ``clean_score``, ``thinking``.

    Gates in order: no_best, overall_pass, facets, score (the clean score, then each facet's floor), no_rollout,
    no_messages, length and waits of the thinking; a gate with 0 or False is off. ``rollouts`` are (index, image,
    messages, raw); of those that repeat a key any may count, so make them unique first.
    """
    got = verified.join(rollouts.select(index, F.col(image).alias(best), "messages", "raw", F.lit(True).alias("__found")), [index, best], "left")
    score = clean_score(F.col("facets"))
    below = F.coalesce(score < least_score, F.lit(True)) if least_score > 0 else F.lit(False)
    for name, floor in (floors or {}).items():
        if floor > 0:
            below = below | F.coalesce(F.element_at("facets", name)["score"] < floor, F.lit(True))
    said = F.filter("messages", lambda m: m["role"] == "assistant")
    raw = F.when(F.length("raw") > 0, F.col("raw")).otherwise(F.get(said, F.lit(0))["content"])
    thinking = F.coalesce(F.regexp_extract(raw, r"(?s)<think>(.*?)</think>", 1), F.lit(""))
    got = got.withColumn("thinking", thinking).withColumn("clean_score", score)
    gates = [
        ("no_best", F.col(best).isNull()),
        ("overall_pass", ~F.coalesce("overall_pass", F.lit(False)) if require_pass else F.lit(False)),
        ("facets", ~facets_pass(F.col("facets")) if require_facets else F.lit(False)),
        ("score", below),
        ("no_rollout", F.col("__found").isNull()),
        ("no_messages", F.coalesce(F.size("messages"), F.lit(0)) <= 0),
        ("length", F.length("thinking") > most_length if most_length else F.lit(False)),
        ("waits", text.waits(F.col("thinking")) > most_waits if most_waits else F.lit(False)),
    ]
    state = F.coalesce(*[F.when(stops, F.lit(name)) for name, stops in gates], F.lit("written"))
    return got.withColumn("state", state).drop("__found", "raw")


def exported(states: DataFrame, tools: str | None = None) -> DataFrame:
    """``line``: the JSON of every written row's messages, and of ``tools`` where there are any."""
    return states.where("state = 'written'").select(F.to_json(F.struct("messages", *([tools] if tools else []))).alias("line"))


def chat_messages(system: Column, prompt: Column, thinking: Column, answer: Column) -> Column:
    """Messages of a training row: system (if any), user, and the answer after its thinking in tags (if any)."""
    tagged = F.when(F.length(thinking) > 0, F.concat(F.lit("<think>\n"), thinking, F.lit("\n</think>\n\n"), answer)).otherwise(answer)
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.filter(F.array(turn("system", system), turn("user", prompt), turn("assistant", tagged)), lambda m: (m["role"] != "system") | (F.length(m["content"]) > 0))


# --- queues of tasks ------------------------------------------------------------------------------------


def task_name(file: Column, parked: Column) -> Column:
    """A task's own name: those that a worker has claimed or done have the worker's before the first underscore."""
    return F.when(parked & F.contains(file, F.lit("_")), F.regexp_replace(file, r"^[^_]*_", "")).otherwise(file)


def backfilled(source: DataFrame, target: DataFrame, file: str = "file", state: str = "state") -> DataFrame:
    """Tasks of an old queue that a new experiment does not have yet, each once, by their own names.

    Of a task that is in several states of the source the pending one counts, then the done, then the claimed one.
    Files that are no JSON are passed over.
    """
    own = task_name(F.col(file), F.col(state) != "pending")
    named = source.where(F.col(file).endswith(".json")).select(own.alias("task"), F.struct(F.when(F.col(state) == "pending", 0).when(F.col(state) == "done", 1).otherwise(2).alias("o"), F.col(file).alias("f"), F.col(state).alias("s")).alias("x"))
    first = named.groupBy("task").agg(F.min("x").alias("x")).select("task", F.col("x.f").alias(file), F.col("x.s").alias(state))
    have = target.select(task_name(F.col(file), F.col(state) != "pending").alias("task")).distinct()
    return first.join(have, "task", "left_anti")
