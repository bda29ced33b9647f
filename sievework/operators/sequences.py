"""Layout of packed samples: places, position ids, attention and loss of their segments and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_weight(n: Column, how: str = "square") -> Column:
    """The loss weight of each of ``n`` tokens; 0 for none."""
    rules = {"token": F.lit(1.0), "sample": 1 / n, "square": 1 / F.sqrt(n)}
    if how not in rules:
        raise ValueError(f"how is one of {', '.join(rules)}")
    return F.when(n == 0, 0.0).otherwise(rules[how])


def grid_positions(height: Column, width: Column, patch: int, side: int, stretched: bool = False) -> Column:
    """Position ids of an image's patches, row by row, on a grid of ``side`` columns.

    Stretched, the patches are spread over the whole grid; otherwise they fill its upper left corner.
    An image smaller than a patch has none.
    """
    rows, columns = (F.floor(x / patch).cast("int") for x in (height, width))

    def along(n: Column) -> Column:
        i = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(i, lambda x: F.floor(x * side / n).cast("int")) if stretched else i

    return F.flatten(F.transform(along(rows), lambda y: F.transform(along(columns), lambda x: y * side + x)))


def layout(
    segments: DataFrame, pack: str, sample: str, place: str, kind: str = "kind", length: str = "length", loss: str = "loss",
    dropped: str = "dropped", frames: str | None = None,
) -> DataFrame:
    """``segments`` that stay in the sequence, with ``start``, ``tokens``, ``rope``, ``attention``, ``loss_kind``, ``loss_tokens``.

    ``kind`` is text, vit or vae. Each segment has two tokens more than its ``length``: before and after it. Texts
    are causal and take a position id for each token; the tokens of an image share one, and an image has noise
    attention if it bears loss (and no ``frames``), full attention otherwise. The next segment's id follows: after
    an image one more, or ``frames`` more, or no more after an image with loss. A dropped text takes no id, a
    dropped image takes one. Position ids begin again with each sample; ``start`` runs through the pack. A text
    with loss bears it on its length and the first token, an image of kind vae on its length, vit never.
    Null ``loss`` or ``dropped`` is no. A pack is bounded by its token limit, so windows over it are too.
    """
    text, image = F.col(kind) == "text", F.col(kind).isin("vit", "vae")
    out, bears = F.coalesce(F.col(dropped), F.lit(False)), F.coalesce(F.col(loss), F.lit(False))
    noisy = (F.col(kind) == "vae") & bears
    delta = F.col(frames) if frames else F.lit(None).cast("int")
    tokens = F.when(out, 0).otherwise(F.col(length) + 2).cast("long")
    after_vae = F.coalesce(F.when(F.col(kind) == "vae", delta), F.when(noisy, 0).otherwise(1))
    ids = F.when(text, tokens).when(out, 1).otherwise(after_vae).cast("long")
    before = Window.partitionBy(pack).orderBy(sample, place).rowsBetween(Window.unboundedPreceding, -1)
    in_sample = Window.partitionBy(pack, sample).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return (
        segments.where(text | image).withColumn("tokens", tokens)
        .withColumn("start", F.coalesce(F.sum("tokens").over(before), zero))
        .withColumn("rope", F.coalesce(F.sum(ids).over(in_sample), zero))
        .where(~out)
        .withColumn("attention", F.when(text, "causal").when(noisy & delta.isNull(), "noise").otherwise("full"))
        .withColumn("loss_kind", F.when(text & bears, "ce").when(noisy, "mse"))
        .withColumn("loss_tokens", F.when(text & bears, F.col(length) + 1).when(noisy, F.col(length)).otherwise(0).cast("long"))
    )


def token_places(laid: DataFrame, pack: str, kind: str = "kind") -> DataFrame:
    """A row for each token of :func:`layout`: pack, place in the pack, position id, whether it bears loss."""
    each = laid.where("tokens > 0").select(pack, kind, "start", "rope", "loss_kind", "loss_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1)).alias("i"))
    first = F.when(F.col(kind) == "text", 0).otherwise(1)
    bears = (F.col("i") >= first) & (F.col("i") < first + F.col("loss_tokens"))
    return each.select(
        pack, (F.col("start") + F.col("i")).alias("position"),
        (F.col("rope") + F.when(F.col(kind) == "text", F.col("i")).otherwise(0)).alias("rope"), F.when(bears, F.col("loss_kind")).alias("loss_kind"),
    )


def loss_by_dataset(losses: DataFrame, runs: DataFrame, pack: str, position: str, loss: str, order: str, dataset: str, length: str) -> DataFrame:
    """``dataset``, ``n``, ``total``: the losses of tokens by the dataset whose run of tokens covers their place.

    ``runs`` lists, in ``order``, how many tokens of a pack come from a dataset. Starts of runs and tokens are
    merged in one sort of each pack, in place of a join by ranges. Tokens beyond all runs, and null losses, are
    not counted.
    """
    before = Window.partitionBy(pack).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(None)
    start = F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long")
    named = runs.where(F.col(length) > 0).select(
        F.col(pack).alias("p"), start.alias("at"), F.lit(0).alias("token"), F.struct(F.col(dataset).alias("name"), (start + F.col(length)).alias("end")).alias("run"),
        nothing.cast("double").alias("loss"))
    tokens = losses.select(F.col(pack).alias("p"), F.col(position).cast("long").alias("at"), F.lit(1).alias("token"), nothing.cast(named.schema["run"].dataType).alias("run"), F.col(loss).cast("double").alias("loss"))
    so_far = Window.partitionBy("p").orderBy("at", "token").rowsBetween(Window.unboundedPreceding, 0)
    found = named.unionByName(tokens).withColumn("run", F.last("run", ignorenulls=True).over(so_far)).where("token = 1 AND loss IS NOT NULL AND at < run.end")
    return found.groupBy(F.col("run.name").alias("dataset")).agg(F.count("loss").alias("n"), F.sum("loss").alias("total"))
