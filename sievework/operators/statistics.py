"""Statistics of points, cells and trajectories over DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.hashing import uniform
from sievework.session import checkpointed


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    """The weighted harmonic mean; 0 where both are 0."""
    b2 = beta * beta
    return F.coalesce(F.try_divide((1 + b2) * precision * recall, b2 * precision + recall), F.lit(0.0))


def yes_share(mask: Column, items: Column) -> Column:
    """YES answers per item; 0 without items."""
    return F.coalesce(F.try_divide(F.size(F.filter(mask, lambda m: m == "YES")), F.size(items)), F.lit(0.0))


def running_sum(rows: DataFrame, order: list[str], value: Column, out: str, groups: list[str] | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row in ``order``, inside ``groups`` if given.

    Rows are dealt to ranges of groups and order, so that neither a table nor a group is one task's: a range adds the
    sums of the ranges before it in its group, of which there are as many as ranges. ``order`` should be total.
    """
    groups = groups or []
    by = [*groups, *order]
    ranged = checkpointed(rows.withColumn("__v", value).repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part", *groups).agg(F.sum("__v").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range and group that begins or ends in it
    offsets = sums.withColumn("__before", before).drop("__s")
    own = F.sum("__v").over(Window.partitionBy("__part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("__part") == F.col("__p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    offsets = offsets.select(F.col("__part").alias("__p"), "__before", *[F.col(g).alias(f"__g_{g}") for g in groups])
    return ranged.withColumn(out, own).join(offsets, same).withColumn(out, F.col(out) + F.col("__before")).drop("__v", "__part", "__p", "__before", *[f"__g_{g}" for g in groups])


def numbered(rows: DataFrame, order: list[str], out: str, groups: list[str] | None = None) -> DataFrame:
    """``rows`` with their place in ``order`` from 0 on."""
    return running_sum(rows, order, F.lit(1).cast("long"), out, groups).withColumn(out, F.col(out) - 1)


def ranked_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each cell's distinct values with their counts ``n``, the rank from 0 (``low``) of the first and the cell's ``size``.

    Values are counted before they are sorted, so a frequent value is one row; no cell is gathered.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__x")).agg(F.count(F.lit(1)).alias("n"))
    # the sizes come from the counts that are kept once
    up = running_sum(counted, ["__x"], F.col("n"), "__to", keys)
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("size"))
    same = [up[k].eqNullSafe(sizes[k]) for k in keys]
    joined = up.join(sizes, same) if keys else up.crossJoin(sizes)
    return joined.select(*[up[k] for k in keys], "__x", "n", (F.col("__to") - F.col("n")).alias("low"), "size")


def cells(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Trimmed mean, upper median, mean and standard error of each cell, which can be of any size.

    The middle of a cell comes from ranks of counted values (:func:`ranked_values`): of a value that lies across a
    cut, as many count as lie inside. Null values are left out; a cell of nulls alone has nulls.
    """
    v = ranked_values(rows, keys, value)
    cut = F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / 5))
    cut = F.when(F.col("size") > 2 * cut, cut).otherwise(F.lit(0))
    high, middle = F.col("low") + F.col("n"), F.floor(F.col("size") / 2)
    inside = F.greatest(F.least(high, F.col("size") - cut) - F.greatest(F.col("low"), cut), F.lit(0))
    trimmed_sums = v.groupBy(*keys).agg(
        F.try_divide(F.sum(inside * F.col("__x")), F.sum(inside)).alias("trim20"),
        F.max(F.when((F.col("low") <= middle) & (middle < high), F.col("__x"))).alias("upper_median"),
    )
    plain = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    same = [plain[k].eqNullSafe(trimmed_sums[k]) for k in keys]
    joined = plain.join(trimmed_sums, same, "left") if keys else plain.crossJoin(trimmed_sums)
    return joined.select(*[plain[k] for k in keys], "n", "mean", F.coalesce(F.col("sd") / F.sqrt("n"), F.lit(0.0)).alias("se"), "trim20", "upper_median")


def line(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, r and R2 of y on x; 0 where x or y is constant."""
    ok = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    m = ok.agg(F.count("x").alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.col("vx")).otherwise(0.0)
    r = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).otherwise(0.0)
    return m.select("n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), r.alias("r"), (r * r).alias("r2"))


def average_ranks(points: DataFrame, column: str, out: str) -> DataFrame:
    """The rank of each row by ``column``; tied rows share the mean of theirs.

    Ranks come from counts by value, so rows are shuffled by value alone and a tied value is one row. Points are kept
    first: those that come from averages would differ in their last bits if made again, and not meet their ranks.
    """
    points = checkpointed(points)
    counts = points.groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    up = running_sum(counts.withColumnRenamed("__v", "__value"), ["__value"], F.col("__n"), "__to")
    ranked = up.select("__value", (F.col("__to") - (F.col("__n") - 1) / 2).alias(out))
    return points.join(ranked, F.col(column) == F.col("__value")).drop("__value")


def spearman(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the correlation of average ranks."""
    return line(average_ranks(average_ranks(points, x, "__rx"), y, "__ry"), "__rx", "__ry").select("n", F.col("r").alias("rho"))


def inversions(points: DataFrame, key: str, x: str, y: str, rising: bool = False) -> DataFrame:
    """One row: pairs of points ordered against the expected direction, and all pairs; ties are no inversions.

    Points are few by nature (one for each cell); all pairs of them are compared.
    """
    p = points.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    a, b = p.alias("a"), p.alias("b")
    sign = F.signum((F.col("a.x") - F.col("b.x")) * (F.col("a.y") - F.col("b.y")))
    wrong = (sign < 0) if rising else (sign > 0)
    return a.join(b, F.col("a.k") < F.col("b.k")).agg(F.count_if(wrong).alias("inversions"), F.count(F.lit(1)).alias("pairs"))


def power_law(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row: y = a * x^b fitted on logarithms, with R2 of y itself."""
    ok = points.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    fit = ok.agg(F.regr_slope(F.ln("y"), F.ln("x")).alias("b"), F.regr_intercept(F.ln("y"), F.ln("x")).alias("la"), F.avg("y").alias("m"))
    return ok.crossJoin(F.broadcast(fit)).groupBy("b", "la").agg(  # fit is one row
        F.sum(F.pow(F.col("y") - F.exp("la") * F.pow("x", F.col("b")), 2)).alias("res"), F.sum(F.pow(F.col("y") - F.col("m"), 2)).alias("tot")
    ).select(F.exp("la").alias("a"), "b", (1 - F.try_divide("res", "tot")).alias("r2"))


def saturation(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float, float, float] | None:
    """Floor, height and rate of ``f + a exp(-k x)`` and R2, by Levenberg-Marquardt; None where it fails."""
    if x.size < 4 or np.ptp(x) == 0:
        return None
    p, damp = np.array([y.min(), max(np.ptp(y), 1e-9), 1 / np.ptp(x)]), 1e-2
    at = lambda q: q[0] + q[1] * np.exp(-q[2] * x)
    best = float(((y - at(p)) ** 2).sum())
    for _ in range(rounds):
        e = np.exp(-p[2] * x)
        j = np.c_[np.ones_like(x), e, -p[1] * x * e]
        h, g = j.T @ j, j.T @ (y - at(p))
        try:
            q = p + np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), g)
        except np.linalg.LinAlgError:
            return None
        with np.errstate(over="ignore"):
            now = float(((y - at(q)) ** 2).sum())
        if np.isfinite(now) and now <= best:
            done, p, best, damp = best - now < 1e-14 * (1 + best), q, now, damp / 3
            if done:
                break
        else:
            damp *= 4
    total = float(((y - y.mean()) ** 2).sum())
    return (*map(float, p), 1 - best / total if total else 0.0)


def saturation_by(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """A fit for each group of points; a group is a few cells."""
    kinds = dict(points.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        got = saturation(pdf[x].to_numpy(float), pdf[y].to_numpy(float))
        return pd.DataFrame([[*pdf[keys].iloc[0], *(got or [None] * 4)]], columns=[*keys, "floor", "height", "rate", "r2"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", floor double, height double, rate double, r2 double"
    return points.dropna(subset=[x, y]).groupBy(*keys).applyInPandas(fit, schema)


def bootstrap(rows: DataFrame, unit: str, cell: list[str], value: str, target: DataFrame, target_value: str, replicates: int = 1000) -> DataFrame:
    """For each replicate: rank correlation and inversions between trimmed cell means and ``target``.

    Units are drawn with replacement, the same for all cells: place k of replicate b is the unit whose number is
    ``floor(u("b|k") * units)``, so that results are equal on every engine. A replicate counts how often it draws each
    unit; a unit's values are joined to those counts, and cells are trimmed by ranks of counted values, as in
    :func:`cells`. Nothing is gathered; work is dealt by replicate, unit and cell.
    """
    table = checkpointed(rows.groupBy(unit, *cell).agg(F.avg(value).alias("__x")).where("__x IS NOT NULL"))
    units = checkpointed(numbered(table.select(unit).distinct(), [unit], "__number"))
    size = units.count()
    if not size:
        return rows.sparkSession.createDataFrame([], "replicate long, rho double, inversions long")
    u = uniform(F.concat_ws("|", "replicate", "place"))
    drawn = rows.sparkSession.range(replicates * size).select((F.col("id") / size).cast("long").alias("replicate"), (F.col("id") % size).alias("place"))
    times = drawn.select("replicate", F.least(F.floor(u * size), F.lit(size - 1)).alias("__number")).groupBy("replicate", "__number").agg(F.count(F.lit(1)).alias("__n"))
    picked = times.join(units, "__number").join(table, unit).select("replicate", *cell, "__x", "__n")
    # a cell has a value for each unit, so a replicate's cell is as small as the table of units
    means = weighted_trims(picked, ["replicate", *cell], "__x", "__n")
    points = means.join(target.select(*cell, F.col(target_value).cast("double").alias("__t")), cell)
    each = checkpointed(points.select("replicate", F.col("trim20").alias("__f"), "__t"))

    def ranks(c: str) -> Column:
        return F.rank().over(Window.partitionBy("replicate").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("replicate", c)) - 1) / 2

    r = each.select("replicate", ranks("__f").alias("a"), ranks("__t").alias("b")).groupBy("replicate").agg(
        F.covar_pop("a", "b").alias("c"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb")
    ).select("replicate", F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("c") / F.sqrt(F.col("va") * F.col("vb"))).alias("rho"))
    # cells are few (a handful for each replicate), so their pairs are made
    one, two = (each.select("replicate", F.col("__f").alias(f"f{k}"), F.col("__t").alias(f"t{k}")) for k in "12")
    wrong = one.join(two, "replicate").where("f1 < f2").groupBy("replicate").agg(F.count_if(F.expr("t1 < t2")).alias("inversions"))
    return r.join(wrong, "replicate", "left").select("replicate", "rho", F.coalesce("inversions", F.lit(0).cast("long")).alias("inversions"))


def weighted_trims(rows: DataFrame, keys: list[str], value: str, times: str) -> DataFrame:
    """Each cell's trimmed mean of values that count several times; a cell's values are sorted in one task."""
    counted = rows.groupBy(*keys, F.col(value).alias("__x")).agg(F.sum(times).alias("n"))
    w = Window.partitionBy(*keys)
    low = F.coalesce(F.sum("n").over(w.orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = counted.withColumn("low", low).withColumn("size", F.sum("n").over(w))
    cut = F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / 5))
    cut = F.when(F.col("size") > 2 * cut, cut).otherwise(F.lit(0))
    inside = F.greatest(F.least(F.col("low") + F.col("n"), F.col("size") - cut) - F.greatest(F.col("low"), cut), F.lit(0))
    return v.groupBy(*keys).agg((F.sum(inside * F.col("__x")) / F.sum(inside)).alias("trim20"))


def bootstrap_summary(replicates: DataFrame, below: tuple[float, ...] = (-0.90, -0.93, -0.95)) -> DataFrame:
    """One row: mean, spread (n - 1), median, intervals and tail shares of the correlations, and mean inversions.

    The bounds of an interval are the values at place ``floor(n * p)`` of the sorted correlations; correlations that
    are undefined are left out.
    """
    ok = replicates.where("rho IS NOT NULL")
    v = ranked_values(ok, [], "rho")
    at = lambda p: F.max(F.when((F.col("low") <= F.least(F.floor(F.col("size") * p), F.col("size") - 1)) & (F.least(F.floor(F.col("size") * p), F.col("size") - 1) < F.col("low") + F.col("n")), F.col("__x")))
    places = v.agg(at(0.5).alias("median"), at(0.025).alias("low95"), at(0.975).alias("high95"), at(0.005).alias("low99"), at(0.995).alias("high99"))
    means = ok.agg(
        F.count(F.lit(1)).alias("n"), F.avg("rho").alias("mean"), F.coalesce(F.stddev_samp("rho"), F.lit(0.0)).alias("sd"), F.avg("inversions").alias("mean_inversions"),
        *[F.avg((F.col("rho") < b).cast("int")).alias(f"below_{round(-100 * b)}") for b in below],
    )
    return means.crossJoin(places)  # one row each


def bootstrap_se(rows: DataFrame, keys: list[str], value: str, replicates: int = 1000, key: str = "se") -> DataFrame:
    """Each cell's standard error of its trimmed mean by resampling; 0 for cells of fewer than four values.

    Place k of replicate b of a cell draws the value of rank ``floor(u("key|cell|b|k") * n)``: values are numbered by
    rank, and draws are counted by rank before they are joined to them. A cell of n values makes ``replicates`` * n
    draws, spread over tasks.
    """
    v = checkpointed(ranked_values(rows, keys, value).select(*keys, "__x", "low", "n", "size"))
    large = v.where("size >= 4")
    cell = F.concat_ws("|", F.lit(key), *[F.col(k).cast("string") for k in keys])
    sizes = large.select(*keys, "size").distinct()
    draws = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    rank = F.least(F.floor(uniform(F.concat_ws("|", cell, "replicate", "place")) * F.col("size")), F.col("size") - 1)
    counted = draws.select(*keys, "replicate", rank.alias("rank")).groupBy(*keys, "replicate", "rank").agg(F.count(F.lit(1)).alias("times"))
    spread = large.select(*keys, "__x", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("n") - 1)).alias("rank"))
    means = weighted_trims(counted.join(spread, [*keys, "rank"]), [*keys, "replicate"], "__x", "times")
    se = means.groupBy(*keys).agg(F.stddev_samp("trim20").alias("se"))
    return v.select(*keys, "size").distinct().join(se, keys, "left").select(*keys, F.col("size").alias("n"), F.coalesce("se", F.lit(0.0)).alias("se"))


def trimmed(v: np.ndarray) -> float:
    """The trimmed mean of an array, for those that have one at hand."""
    if not v.size:
        return float("nan")
    v, t = np.sort(v), max(1, v.size // 5)
    return float((v[t : v.size - t] if v.size > 2 * t else v).mean())


def subsample(rows: DataFrame, unit: str, sizes: list[int], replicates: int) -> DataFrame:
    """``rows`` of units drawn without replacement, for every size and replicate: the units with the least hashes."""
    units = rows.select(unit).distinct()
    each = units.select(unit, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    u = uniform(F.concat_ws("|", F.col("replicate").cast("string"), F.col(unit).cast("string")))
    # a limit by rank inside the window lets tasks keep their own least before the shuffle
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy("replicate").orderBy(u, unit))).where(F.col("place") <= max(sizes))
    picked = placed.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("place <= size").drop("place")
    return rows.join(picked, unit)


def candidates(points: DataFrame, value: str) -> DataFrame:
    """Transforms of a metric that were tried, beside it; they need its least, mean and greatest value."""
    g = F.col(value)
    s = points.agg(F.min(value).alias("__lo"), F.avg(value).alias("__mean"))
    caps = {f"capacity_{c}": F.when(g < c, -F.ln(1 - g / c)) for c in (220, 230, 250, 280)}
    powers = {f"power_{p}": F.pow(g / F.col("__mean"), F.lit(p)) for p in (1.5, 2.0, 3.0)}
    out = {"squared": g * g / F.col("__mean"), "exp": F.exp(g / 60.0) - 1, "tail": g * F.exp((g - F.col("__lo")) / 200.0)}
    return points.crossJoin(F.broadcast(s)).withColumns(out | caps | {k.replace(".", "_"): v for k, v in powers.items()}).drop("__lo", "__mean")


def rising_steps(points: DataFrame, order: str, value: str) -> DataFrame:
    """One row: how many neighbours by ``order`` rise in ``value``, and by how much in all.

    Rows are numbered over ranges and each is joined to the one before it.
    """
    n = checkpointed(numbered(points.select(F.col(order).alias("__o"), F.col(value).alias("__y")), ["__o"], "__k"))
    step = n.join(n.select((F.col("__k") + 1).alias("__k"), F.col("__y").alias("__before")), "__k").select((F.col("__y") - F.col("__before")).alias("d"))
    return step.agg(F.count_if(F.col("d") > 0).alias("violations"), F.coalesce(F.sum(F.greatest("d", F.lit(0.0))), F.lit(0.0)).alias("total"))


def grounding_gain(rows: DataFrame, keys: list[str], prior: str, grounded: str, tokens: str) -> DataFrame:
    """By ``keys``: the mean of how much less a text costs a model with its picture than without (``gpg``, mean negative
    log-likelihoods), its standard error (0 for one row) and ``total``, the gain over all tokens."""
    gain = F.col(prior) - F.col(grounded)
    return rows.groupBy(*keys).agg(
        F.count(gain).alias("n"), F.avg(gain).alias("gpg"), F.coalesce(F.stddev_samp(gain) / F.sqrt(F.count(gain)), F.lit(0.0)).alias("se"), F.sum(gain * F.col(tokens)).alias("total")
    )
