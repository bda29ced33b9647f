"""Readers and writers of JSON lines, CSV and Parquet records, and benchmark prompts in one schema."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.hashing import uniform
from sievework.functions.text import mime_type, trimmed
from sievework.operators.filters import embedded_caption
from sievework.operators.statistics import numbered

PROMPT = "id string, benchmark string, category string, prompt string"


def json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """Records of JSON lines; a bad line is an error, or passed over if not ``strict``. Blank lines are passed over."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return _parsed(spark, path, schema).where("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def _parsed(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """``file``, ``line`` and the record ``r`` of every line that is not blank."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")
    return rows.withColumn("r", F.from_json("line", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))


def corrupt_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """What :func:`json_lines` passes over: the bad lines and their files, for quarantine."""
    return _parsed(spark, path, schema).where("r._corrupt_record IS NOT NULL").select("file", "line")


def required(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows``; reading one without a required field is an error."""
    for f in fields:
        rows = rows.withColumn(f, F.when(F.col(f).isNull(), F.raise_error(F.lit(f"a record has no {f}")).cast(dict(rows.dtypes)[f])).otherwise(F.col(f)))
    return rows


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file``, ``line`` (from 0, blank ones counted) and ``value`` of text files, of any size: a file is read in its
    blocks, and lines are numbered over ranges of them."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), "value")
    return numbered(rows, ["__block", "__at"], "line", ["file"]).select("file", F.col("line").cast("int").alias("line"), "value").where("trim(value) <> ''")


def shards(spark: SparkSession, folder: str, n: int, schema: str, pattern: str = "shard{}.jsonl") -> DataFrame:
    """Records of the shards 0 to n - 1 of a folder that are there; without any, no records."""
    names = [pattern.format(i) for i in range(n)]
    found = spark.read.text(folder, pathGlobFilter="{" + ",".join(names) + "}") if _exists(spark, folder, names) else None
    if found is None:
        return spark.createDataFrame([], schema)
    rows = found.where("trim(value) <> ''").select(F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.where("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def _exists(spark: SparkSession, folder: str, names: list[str]) -> bool:
    """Whether any file of these names is in a folder that Spark can read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return any(fs.exists(jvm.org.apache.hadoop.fs.Path(path, n)) for n in names)


def first_records(spark: SparkSession, path: str | list[str], schema: str, keys: list[str]) -> DataFrame:
    """Records of many JSON line files, one for each key: the first by file name and line. Bad lines are passed over."""
    rows = _parsed(spark, path, schema).where("r._corrupt_record IS NULL").select("file", F.monotonically_increasing_id().alias("__at"), "r.*").drop("_corrupt_record")
    rest = [c for c in rows.columns if c not in (*keys, "file", "__at")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("file", "__at")).alias("__r")).select(*keys, "__r.*")


def resolved_paths(spark: SparkSession, source: str, index_root: str | None = None) -> list[str]:
    """Parquet files of a folder, of any file system that Spark reads, or those that ``index_root/<source>.txt`` lists.

    A list of names on the driver, in order of names (of lines, for a list); none is an error.
    """
    if index_root and _exists(spark, index_root, [f"{source}.txt"]):
        lines = [r.value.strip() for r in spark.read.text(f"{index_root}/{source}.txt", wholetext=True).select(F.explode(F.split("value", "\n")).alias("value")).collect()]
        found = [x for x in lines if x.endswith(".parquet")]
    else:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(source)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted(str(f.getPath().toString()) for f in fs.listStatus(path) if f.getPath().getName().endswith(".parquet"))
    if not found:
        raise ValueError(f"no Parquet files in {source}")
    return found


def parquet_prompts(spark: SparkSession, paths: list[str], most_rows: int = 0, done: DataFrame | None = None) -> DataFrame:
    """``id``, ``parquet_file``, ``structured_prompt`` of the embedded prompts of Parquet files that are valid JSON.

    An id is ``pqNNNN_rgG_rowR``: the file's place in ``paths``, its row group and the row in that. Row groups are told by
    their row counts, which the driver reads from footers alone. With ``most_rows``, only so many rows of a file's first
    group count. Ids in ``done`` are left out.
    """
    import pyarrow.parquet as pq  # only for footers that Spark's readers do not tell
    from pyarrow.fs import FileSystem

    groups = []
    for i, path in enumerate(paths):
        fs, inner = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        with fs.open_input_file(inner) as f:
            meta, first = pq.ParquetFile(f).metadata, 0
            for g in range(meta.num_row_groups):
                n = meta.row_group(g).num_rows
                groups.append((path.rsplit("/", 1)[-1], i, g, first, first + n))
                first += n
    # a row for each row group, which is of some hundred megabytes
    dim = spark.createDataFrame(groups, "parquet_file string, __pq int, __rg int, __from long, __to long")
    if most_rows > 0:
        dim = dim.where("__rg = 0").withColumn("__to", F.least(F.col("__to"), F.lit(most_rows).cast("long")))
    rows = spark.read.parquet(*paths).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("parquet_file"), F.col("_metadata.row_index").alias("__row"), "inputs")
    placed = rows.join(F.broadcast(dim), "parquet_file").where("__row >= __from AND __row < __to")
    prompt = embedded_caption(F.col("inputs"))
    out = placed.select(
        F.format_string("pq%04d_rg%d_row%d", "__pq", "__rg", F.col("__row") - F.col("__from")).alias("id"), "parquet_file", prompt.alias("structured_prompt")
    ).where("structured_prompt IS NOT NULL AND try_parse_json(structured_prompt) IS NOT NULL")
    return out if done is None else out.join(done.select("id").distinct(), "id", "left_anti")


def next_stage(rows: DataFrame) -> DataFrame:
    """The output of one rewriting as the input of the next: its prompt is the rewritten one, the original stays."""
    have = lambda c, instead: F.coalesce(F.col(c), F.lit(instead)) if c in rows.columns else F.lit(instead)
    category = F.col("category") if "category" in rows.columns else F.lit(None).cast("string")
    return rows.select("id", have("benchmark", "custom").alias("benchmark"), category.alias("category"), F.col("rewritten_prompt").alias("prompt"), have("original_prompt", "").alias("original_prompt"))


def rewritten(spark: SparkSession, path: str) -> DataFrame:
    """``id, benchmark, category, original_prompt, rewritten_prompt, width, height`` from either form of rewritten records.

    If the first line has ``json_output`` and no ``benchmark``, all lines are of the custom form, whose id is the file's
    name without its ending, or the line's number.
    """
    lines = numbered_lines(spark, path)
    first = lines.orderBy("file", "line").limit(1).select(F.json_object_keys("value").alias("k")).collect()  # one row
    custom = bool(first) and "json_output" in (first[0].k or []) and "benchmark" not in first[0].k
    size = [_field(c).cast("int").alias(c) for c in ("width", "height")]
    if not custom:
        return lines.select(*[_field(c).alias(c) for c in ("id", "benchmark", "category", "original_prompt", "rewritten_prompt")], *size)
    name = F.regexp_replace(F.coalesce(_field("filename"), F.col("line").cast("string")), r"\.[^.]*$", "")
    return lines.select(name.alias("id"), F.lit("random").alias("benchmark"), F.lit(None).cast("string").alias("category"), F.coalesce(_field("image_key"), name).alias("original_prompt"), _field("json_output").alias("rewritten_prompt"), *size)


def answer_tree(spark: SparkSession, root: str) -> DataFrame:
    """``model``, ``attribute``, ``length``, ``correct`` of every answered question in ``root/model/attribute/length/*.json``.

    Answers are compared trimmed and in lower case, place by place; files that are no JSON have none.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.split(F.col("_metadata.file_path"), "/").alias("p"), F.from_json("value", "gt_answers array<string>, model_pred array<string>").alias("r"))
    part = lambda i: F.element_at("p", i)
    n = F.least(F.size("r.gt_answers"), F.size("r.model_pred"))
    both = files.where(n > 0).select(part(-4).alias("model"), part(-3).alias("attribute"), part(-2).alias("length"), F.explode(F.slice(F.arrays_zip("r.gt_answers", "r.model_pred"), 1, n)).alias("a"))
    return both.select("model", "attribute", "length", (F.lower(trimmed(F.col("a.gt_answers"))) == F.lower(trimmed(F.col("a.model_pred")))).alias("correct"))


def json_results(spark: SparkSession, root: str, schema: str, allowed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Records of all JSON files below a folder, one in a file; with ``allowed``, those whose key it has."""
    rows = spark.read.schema(schema).json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return rows if allowed is None else rows.join(allowed.select(key).distinct(), key, "left_semi")


def image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``mime``, ``width``, ``height``, ``content`` of pictures; sizes are read from the heads of PNG and GIF."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    number = lambda at, n, swap: F.conv(F.hex(F.reverse(F.substring("content", at, n)) if swap else F.substring("content", at, n)), 16, 10).cast("int")
    little = lambda at: F.conv(F.concat(F.hex(F.substring("content", at + 1, 1)), F.hex(F.substring("content", at, 1))), 16, 10).cast("int")
    mime = mime_type(F.col("content"))
    size = lambda png, gif: F.when(mime == "image/png", number(png, 4, False)).when(mime == "image/gif", little(gif))
    return rows.select("path", mime.alias("mime"), size(17, 7).alias("width"), size(21, 9).alias("height"), "content")


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def metric_csv(spark: SparkSession, path: str, step: str, loss: str, tokens: str) -> DataFrame:
    """Numbers or null; rows without a step are left out."""
    rows = csv_text(spark, path).select(F.col("_metadata.file_path").alias("file"), *[F.expr(f"try_cast(`{c}` AS double)").alias(n) for c, n in ((step, "step"), (loss, "loss"), (tokens, "tokens"))])
    return rows.where("step IS NOT NULL").withColumn("step", F.col("step").cast("long"))


def parquet_rows(spark: SparkSession, path: str | list[str], after: tuple[str, int] | None = None) -> DataFrame:
    """Parquet rows with ``file`` and ``row``, from behind a cursor if one is given."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path)).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows if after is None else rows.where((F.col("file") > after[0]) | ((F.col("file") == after[0]) & (F.col("row") > after[1])))


def repeated_paths(paths: list[str], n: int, reverse: bool = False) -> list[str]:
    """``n`` paths, the list over again as often as needed: it is repeated once more than it fits, then turned round if
    ``reverse``, then cut."""
    order = paths * (n // len(paths) + 1) if paths else []
    return (order[::-1] if reverse else order)[:n]


def sampled_files(files: DataFrame, path: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` files by hash: a list of names, not their contents."""
    return files.orderBy(uniform(F.concat_ws("|", F.lit(str(seed)), F.col(path))), path).limit(n)


def file_split(files: DataFrame, path: str, world: int, rank: int, workers: int, worker: int, seed: int = 42) -> DataFrame:
    """The files of one worker: hashed order, equal floor shares, what is left over dropped, order reversed."""
    chance = files.select(path, uniform(F.concat_ws("|", F.lit(str(seed)), F.col(path))).alias("__u"))
    placed = numbered(chance, ["__u", path], "place").crossJoin(F.broadcast(files.agg(F.count(F.lit(1)).alias("n"))))  # one row
    per_rank = F.floor(F.col("n") / world)
    per_worker = F.floor(per_rank / workers)
    first = per_rank * rank + per_worker * worker
    return placed.where((F.col("place") >= first) & (F.col("place") < first + per_worker)).orderBy(F.col("place").desc()).select(path)


def prompt_pairs(rows: DataFrame) -> DataFrame:
    """``index``, ``prompt``, ``structured_prompt``, ``width``, ``height`` from chat messages or flat records.

    ``rows`` have ``line``, ``messages`` (array of role and content) and the flat fields; null means absent.
    """
    user, answer = F.get("messages", F.lit(1))["content"], F.get("messages", F.lit(2))["content"]
    m = r"(?s)^(.*?)\s*\[width:\s*(\d+),\s*height:\s*(\d+)\]"
    chat = rows.where(F.col("messages").isNotNull() & (F.size("messages") >= 3) & user.rlike(m)).select(
        F.col("line").cast("long").alias("index"), F.trim(F.regexp_extract(user, m, 1)).alias("prompt"), answer.alias("structured_prompt"),
        F.regexp_extract(user, m, 2).cast("int").alias("width"), F.regexp_extract(user, m, 3).cast("int").alias("height"),
    )
    flat = rows.where(F.col("messages").isNull()).select(
        F.coalesce("index", F.col("line").cast("long")).alias("index"), F.coalesce("prompt", "query").alias("prompt"), "structured_prompt", "width", "height"
    ).where("prompt IS NOT NULL AND structured_prompt IS NOT NULL")
    return chat.unionByName(flat)


# --- benchmark prompts --------------------------------------------------------------------------------


def _unified(rows: DataFrame, benchmark: str, key: Column, category: Column, prompt: str, *more: str) -> DataFrame:
    return rows.select(key.cast("string").alias("id"), F.lit(benchmark).alias("benchmark"), category.cast("string").alias("category"), F.col(prompt).alias("prompt"), *more)


def _field(name: str) -> Column:
    return F.get_json_object("value", f"$['{name}']")


def _by_line(spark: SparkSession, path: str, benchmark: str, key: Column, category: Column, prompt: str = "prompt") -> DataFrame:
    rows = numbered_lines(spark, path).withColumn("__prompt", _field(prompt))
    return _unified(rows, benchmark, key, category, "__prompt")


def load_prompts(spark: SparkSession, benchmark: str, path: str) -> DataFrame:
    """Prompts of a benchmark as ``id, benchmark, category, prompt`` (and a size where it has one); an unknown name is an error."""
    null, line = F.lit(None), F.col("line")
    by_line = {
        "geneval2": (line, null, "prompt"),
        "genevalpp": (line + 1, _field("tag"), "prompt"),
        "geneval": (F.lpad(line.cast("string"), 5, "0"), _field("tag"), "prompt"),
        "genexam": (_field("id"), F.nullif(F.substring_index(F.coalesce(_field("taxonomy"), F.lit("")), "/", 1), F.lit("")), "prompt"),
        "textbench": (_field("prompt_id"), _field("length"), "prompt"),
        "corebench": (_field("ID"), F.concat(F.coalesce(_field("Main Class"), F.lit("")), F.lit("/"), F.coalesce(_field("Sub Class"), F.lit(""))), "Prompt"),
        **{n: (_field("id"), _field("category"), "original_prompt") for n in ("sp_l10_200", "sp_sft_200", "sp_rl_200")},
    }
    if benchmark in by_line:
        name = "sp_l10_200" if benchmark.startswith("sp_") else benchmark
        return _by_line(spark, path, name, *by_line[benchmark])
    if benchmark == "infograph":
        rows = numbered_lines(spark, path).withColumns({"__prompt": _field("prompt"), "width": _field("width").cast("int"), "height": _field("height").cast("int")})
        return _unified(rows, benchmark, _field("id"), null, "__prompt", "width", "height")
    if benchmark == "dpgbench":
        rows = csv_text(spark, path).withColumn("__n", F.monotonically_increasing_id())
        first = rows.groupBy("item_id").agg(F.min_by("text", "__n").alias("text"))
        return _unified(first, benchmark, F.col("item_id"), null, "text")
    if benchmark == "oneig":
        rows = csv_text(spark, path).withColumn("category", F.coalesce("category", F.lit("")))
        return _unified(rows, benchmark, F.concat_ws("/", "category", "id"), F.col("category"), "prompt_en")
    if benchmark == "wise":
        rows = spark.read.json(path, multiLine=True).where(~F.contains(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("rewrite")))
        kind = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("Subcategory", "Category") if c in rows.columns])
        return _unified(rows, benchmark, F.col("prompt_id"), kind, "Prompt")
    if benchmark in ("tiif_short", "tiif_long"):
        return _by_line(spark, path, benchmark, F.concat(_field("type"), F.lit("/"), F.col("line").cast("string")), _field("type"), f"{benchmark[5:]}_description")
    if benchmark in ("tiif_testmini_short", "tiif_testmini_long"):
        whole = load_prompts(spark, benchmark.replace("testmini_", ""), f"{path}/test_prompts/*_prompts.jsonl")
        chosen = spark.read.text(f"{path}/testmini_sample_idx.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("type", "ids"))
        ids = chosen.select("type", F.explode("ids").alias("i")).select(F.concat_ws("/", "type", F.col("i").cast("string")).alias("id"))
        return whole.join(ids.distinct(), "id", "left_semi").withColumn("benchmark", F.lit(benchmark))
    if benchmark in ("alignment_v5", "alignment_v5_long"):
        rows = numbered_lines(spark, path).withColumn("value", F.trim("value")).where(F.contains("value", F.lit("\t")))
        cut = rows.select(F.substring_index("value", "\t", 1).alias("k"), F.regexp_replace("value", r"^[^\t]*\t", "").alias("p"))
        return _unified(cut, benchmark, F.col("k"), null, "p")
    raise ValueError(f"unknown benchmark {benchmark}")


# --- writers --------------------------------------------------------------------------------------------


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path, ignoreNullFields=False)


def emit(rows: DataFrame, path: str, strict: bool = True, order: list[str] | None = None) -> None:
    """All files or none, by the commit protocol; an existing target is an error if ``strict``.

    With ``order``, files follow each other in it: rows are dealt to ranges and sorted inside them.
    """
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    rows.write.mode("errorifexists" if strict else "overwrite").json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file of a line each, nulls kept."""
    rows.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def picture_grid(pictures: list[tuple[int, int, bytes]], rows: int = 2, columns: int = 2) -> tuple[int, int, bytes]:
    """Pictures (width, height, RGB bytes) beside each other, row by row; missing places are black.

    All get the size of the first: others are scaled by their nearest pixels.
    """
    if not pictures:
        raise ValueError("a grid needs a picture")
    w, h, _ = pictures[0]
    out = np.zeros((h * rows, w * columns, 3), np.uint8)
    for i, (pw, ph, data) in enumerate(pictures[: rows * columns]):
        own = np.frombuffer(data, np.uint8).reshape(ph, pw, 3)
        own = own[(np.arange(h) * ph // h)[:, None], np.arange(w) * pw // w]
        r, c = divmod(i, columns)
        out[r * h : (r + 1) * h, c * w : (c + 1) * w] = own
    return w * columns, h * rows, out.tobytes()


def picture_grids(rows: DataFrame, key: list[str], order: str, picture: str, across: int = 2, down: int = 2) -> DataFrame:
    """``key`` and a ``grid`` of each group's pictures (structs of width, height and data), a handful, in ``order``."""
    got = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, picture))).alias("__p"))

    @F.pandas_udf("width int, height int, data binary")
    def grid(pictures: pd.Series) -> pd.DataFrame:
        made = [picture_grid([(p[picture]["width"], p[picture]["height"], bytes(p[picture]["data"])) for p in ps], down, across) for ps in pictures]
        return pd.DataFrame(made, columns=["width", "height", "data"])

    return got.select(*key, grid("__p").alias("grid"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def by_source_file(rows: DataFrame, path: str, file: str = "file") -> None:
    """One folder for each input file's stem."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(file), "/"), -1), r"\.[^.]*$", "")
    rows.withColumn("stem", stem).write.mode("overwrite").partitionBy("stem").json(path)


def image_path(benchmark: str, prompt_id: Column, category: Column, n: Column) -> Column:
    """Where a benchmark's judge looks for image ``n`` of a prompt."""
    flat = F.format_string("%s_%d.png", prompt_id, n)
    return {
        "geneval": F.format_string("%s/samples/%d.png", prompt_id, n),
        "geneval2": F.format_string("images/%s.png", prompt_id), "genevalpp": F.format_string("%s.png", prompt_id),
        "textbench": F.format_string("%04d_%d.png", prompt_id.cast("int"), n + 1),
        "oneig": F.format_string("%s/%s.webp", category, F.element_at(F.split(prompt_id, "/"), -1)),
        "dpgbench": F.format_string("%s.png", prompt_id), "wise": F.format_string("%s.png", prompt_id), "genexam": F.format_string("%s.png", prompt_id),
        "tiif_short": F.format_string("%s/short_description/%s.png", category, F.element_at(F.split(prompt_id, "/"), -1)),
        "tiif_long": F.format_string("%s/long_description/%s.png", category, F.element_at(F.split(prompt_id, "/"), -1)),
    }.get(benchmark, flat)
