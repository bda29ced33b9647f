"""Every query over the supplied tables by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import geometry, hashing, stats, text
from sievework.operators import documents as D
from sievework.operators import relational as R
from sievework.operators import sequences as Q
from sievework.operators import statistics as S
from sievework.streaming import queues

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on the order of partitions in their last bits."""
    return df.select(*[F.round(c, n).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# --- statistics -----------------------------------------------------------------------------------------


@query("""
WITH r AS (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
         count(*) OVER (PARTITION BY event_type) AS n
  FROM events WHERE value IS NOT NULL),
c AS (SELECT *, greatest(1, n // 5) AS cut FROM r)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean,
       round(coalesce(stddev_samp(value) / sqrt(count(*)), 0), 6) AS se,
       round(avg(value) FILTER (WHERE n <= 2 * cut OR (i >= cut AND i < n - cut)), 6) AS trim20,
       round(max(value) FILTER (WHERE i = n // 2), 6) AS upper_median
FROM c GROUP BY event_type""")
def robust_group_stats(spark, sf_dir):
    return rounded(S.cells(read(spark, sf_dir, "events"), ["event_type"], "value"))


_POINTS = """p AS (
  SELECT c_nationkey AS k, avg(c_acctbal) AS x, avg(o_totalprice) AS y
  FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey)"""


def _points(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey).groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x"), F.avg("o_totalprice").alias("y"))


@query(f"""WITH {_POINTS}
SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept,
       round(corr(x, y), 6) AS r, round(corr(x, y) * corr(x, y), 6) AS r2 FROM p""")
def pearson_line(spark, sf_dir):
    return S.line(_points(spark, sf_dir), "x", "y").select(
        "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r", 6).alias("r"), F.round("r2", 6).alias("r2"))


@query(f"""WITH {_POINTS},
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def spearman(spark, sf_dir):
    return rounded(S.spearman(_points(spark, sf_dir), "x", "y"))


@query(f"""WITH {_POINTS}
SELECT count(*) FILTER (WHERE sign((a.x - b.x) * (a.y - b.y)) > 0) AS inversions, count(*) AS pairs
FROM p a JOIN p b ON a.k < b.k""")
def inversions(spark, sf_dir):
    return S.inversions(_points(spark, sf_dir), "k", "x", "y")


@query(f"""WITH {_POINTS},
f AS (SELECT regr_slope(ln(y), ln(x)) AS b, regr_intercept(ln(y), ln(x)) AS la, avg(y) AS m FROM p WHERE x > 0 AND y > 0)
SELECT round(exp(la), 3) AS a, round(b, 6) AS b, round(1 - sum((y - exp(la) * x ** b) ** 2) / sum((y - m) ** 2), 6) AS r2
FROM p, f WHERE x > 0 AND y > 0 GROUP BY la, b""")
def power_law(spark, sf_dir):
    return S.power_law(_points(spark, sf_dir), "x", "y").select(F.round("a", 3).alias("a"), F.round("b", 6).alias("b"), F.round("r2", 6).alias("r2"))


@query()
def saturation_fit(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_orderpriority", F.month("o_orderdate").cast("double").alias("x")).agg(F.avg("o_totalprice").alias("y"))
    return rounded(S.saturation_by(o, ["o_orderpriority"], "x", "y"), 3)


@query()
def bootstrap_rank(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("unit", F.col("o_custkey") % 200)
    goal = o.groupBy("o_orderpriority").agg(F.avg("o_orderkey").alias("t"))
    return rounded(S.bootstrap(o, "unit", ["o_orderpriority"], "o_totalprice", goal, "t", replicates=1000))


@query("""
WITH u AS (SELECT DISTINCT user_id FROM events),
e AS (SELECT user_id, r AS replicate, row_number() OVER (PARTITION BY r ORDER BY sha256(r::VARCHAR || '|' || user_id::VARCHAR)[1:13], user_id) AS place
      FROM u, range(0, 3) t(r))
SELECT size, replicate::INT AS replicate, round(avg(value), 6) AS mean, count(*) AS n
FROM events JOIN e USING (user_id), (VALUES (5), (20)) s(size) WHERE place <= size GROUP BY ALL""")
def n_scaling(spark, sf_dir):
    s = S.subsample(read(spark, sf_dir, "events"), "user_id", [5, 20], 3)
    return rounded(s.groupBy("size", "replicate").agg(F.avg("value").alias("mean"), F.count("value").alias("n")))


@query("""
WITH s AS (SELECT min(p_retailprice) AS lo, avg(p_retailprice) AS m FROM part)
SELECT p_partkey, round(p_retailprice * p_retailprice / m, 4) AS squared, round((p_retailprice / m) ** 1.5, 6) AS power_1_5,
       round(p_retailprice * exp((p_retailprice - lo) / 200.0), 2) AS tail
FROM part, s""")
def metric_candidates(spark, sf_dir):
    c = S.candidates(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice")
    return c.select("p_partkey", F.round("squared", 4).alias("squared"), F.round("power_1_5", 6).alias("power_1_5"), F.round("tail", 2).alias("tail"))


@query("""
WITH d AS (SELECT date_trunc('month', o_orderdate) AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1),
s AS (SELECT v - lag(v) OVER (ORDER BY m) AS d FROM d)
SELECT count(*) FILTER (WHERE d > 0) AS violations, round(sum(greatest(d, 0)), 4) AS total FROM s""")
def monotonic_violations(spark, sf_dir):
    m = read(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(S.rising_steps(m, "m", "v"), 4)


@query("""
SELECT l.doc_id, round(CASE WHEN p = 0 AND r = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END, 6) AS f_half
FROM (SELECT doc_id, (quality + toxic) / 2.0 AS p, quality::DOUBLE AS r FROM labels) l JOIN documents USING (doc_id)""")
def fbeta_by_doc(spark, sf_dir):
    masks = read(spark, sf_dir, "labels").select(
        "doc_id", F.array(*[F.when(F.col(c) == 1, "YES").otherwise("NO") for c in ("quality", "toxic")]).alias("cp"), F.array(F.when(F.col("quality") == 1, "YES").otherwise("NO")).alias("sr"))
    f = S.f_beta(S.yes_share(F.col("cp"), F.col("cp")), S.yes_share(F.col("sr"), F.col("sr")))
    return masks.join(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", F.round(f, 6).alias("f_half"))


# --- keys, sampling, duplicates, shards -----------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id, n_chars, sha1(source::BLOB || '\\x00'::BLOB || encode(text)) AS cap_key FROM documents)
SELECT doc_id, d.cap_key, m.n_chars FROM d JOIN (SELECT DISTINCT cap_key, n_chars FROM d) m USING (cap_key)""")
def cap_key_join(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("cap_key", hashing.caption_key(F.col("source"), F.col("text")))
    return d.select("doc_id", "cap_key").join(d.select("cap_key", "n_chars").distinct(), "cap_key")


@query("""
SELECT doc_id, ('0x' || right(sha256(doc_id::VARCHAR || '_0'), 8))::BIGINT & 2147483647 AS seed,
       'img_' || left(sha1(source), 16) AS uid,
       CASE WHEN u < 0.5 THEN 'l10' WHEN u < 0.8 THEN 'l8' ELSE 'l5' END AS level
FROM (SELECT *, ('0x' || left(sha256('level|' || doc_id::VARCHAR), 13))::BIGINT / 4503599627370496.0 AS u FROM documents)""")
def stable_seed(spark, sf_dir):
    u = hashing.uniform(F.concat(F.lit("level|"), F.col("doc_id").cast("string")))
    return read(spark, sf_dir, "documents").select(
        "doc_id", hashing.rollout_seed(F.col("doc_id"), F.lit(0)).alias("seed"), hashing.image_uid(F.col("source")).alias("uid"),
        hashing.weighted(u, [("l10", 5.0), ("l8", 3.0), ("l5", 2.0)]).alias("level"))


_KEEP = "least(greatest(0.001 + 0.998 * 0.7 * exp(-1.5 * (i - 1) / (n - 1)), 0.001), 0.999)"


@query(f"""
WITH k AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, i::INT AS place, round(CASE WHEN n = 1 THEN 1.0 ELSE {_KEEP} END, 9) AS p
FROM (SELECT l_orderkey, n, unnest(range(1, n + 1)) AS i FROM k)""")
def keep_probabilities(spark, sf_dir):
    k = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    p = k.select("l_orderkey", F.posexplode(hashing.keep_probabilities(F.col("n").cast("int"), 0.7, 1.5)).alias("i", "p"))
    return p.select("l_orderkey", (F.col("i") + 1).alias("place"), F.round("p", 9).alias("p"))


@query("SELECT source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def dedupe_first(spark, sf_dir):
    return R.first_of(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"])


@query("SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def dedupe_last(spark, sf_dir):
    return R.first_of(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], last=True)


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def dedupe_content(spark, sf_dir):
    return R.distinct_content(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["text", "lang"], ["doc_id"]).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf_dir):
    return R.remaining(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT event_id, event_id // 100 AS shard_id FROM events WHERE (event_id // 100) % 4 = 1 AND event_id // 100 NOT IN (SELECT item_id FROM benchmark)")
def shard_plan(spark, sf_dir):
    done = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("shard_id"))
    return R.shard_plan(read(spark, sf_dir, "events").select("event_id"), "event_id", 100, 4, 1, done)


@query("SELECT lang, count(*) AS n, count(quality) AS found FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def join_misses(spark, sf_dir):
    m = R.with_misses(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), ["doc_id"])
    return m.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("found"))


# --- series ---------------------------------------------------------------------------------------------

_TRAJECTORY = """s AS (
  SELECT event_type AS run, user_id % 2 AS file, event_id AS step, event_id % 7 - 1 AS tokens,
         CASE WHEN event_id % 3 = 0 THEN value END AS loss FROM events),
t AS (SELECT run, step, sum(CASE WHEN tokens > 0 THEN tokens ELSE 0 END) OVER (PARTITION BY run ORDER BY file, step) AS cum,
             last_value(loss IGNORE NULLS) OVER (PARTITION BY run, file ORDER BY step ROWS UNBOUNDED PRECEDING) AS loss FROM s)"""


def _trajectory(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), (F.col("user_id") % 2).alias("file"), F.col("event_id").alias("step"),
        (F.col("event_id") % 7 - 1).cast("double").alias("tokens"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("loss"))
    return R.trajectory(e, "run", "file", "step", "tokens", "loss")


@query(f"WITH {_TRAJECTORY} SELECT run, step, cum::DOUBLE AS cum, round(loss, 6) AS loss FROM t WHERE cum > 0 AND loss IS NOT NULL")
def cumulative_budget(spark, sf_dir):
    return rounded(_trajectory(spark, sf_dir).select("run", "step", "cum", "loss"))


@query(f"""WITH {_TRAJECTORY}, k AS (SELECT * FROM t WHERE cum > 0 AND loss IS NOT NULL),
b AS (SELECT min(m) AS budget FROM (SELECT max(cum) AS m FROM k GROUP BY run)),
n AS (SELECT run, loss, row_number() OVER (PARTITION BY run ORDER BY loss) - 1 AS i, count(*) OVER (PARTITION BY run) AS c
      FROM k, b WHERE cum BETWEEN budget * 0.98 AND budget * 1.02)
SELECT run, round(max(loss) FILTER (WHERE i = c // 2), 6) AS loss FROM n GROUP BY run""")
def smoothed_at_budget(spark, sf_dir):
    series = _trajectory(spark, sf_dir)
    both = series.crossJoin(F.broadcast(R.unified_budget(series, "run")))  # one row
    return rounded(R.smoothed_at(both, "run", F.col("budget")))


@query("""
WITH d AS (SELECT DISTINCT user_id % 5 AS g, event_id // 3 * 2 + event_id % 2 AS v FROM events),
k AS (SELECT g, v, v - row_number() OVER (PARTITION BY g ORDER BY v) AS k FROM d)
SELECT g, min(v) AS first, max(v) AS last, count(*) AS length FROM k GROUP BY g, k""")
def islands(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("g"), (F.floor(F.col("event_id") / 3) * 2 + F.col("event_id") % 2).alias("v"))
    return R.islands(e, "g", "v")


# line numbers repeat inside some orders: one row for each is what order-dependent queries work on
_LINES = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL"


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"))


@query(f"SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w - l_quantity AS begin, sum(l_quantity) OVER w AS end FROM ({_LINES}) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)")
def segment_offsets(spark, sf_dir):
    return R.offsets(_lines(spark, sf_dir).drop("l_partkey"), "l_orderkey", "l_linenumber", "l_quantity").drop("l_quantity")


# --- roll-ups -------------------------------------------------------------------------------------------


@query("""
WITH g AS (SELECT event_type, count(*) FILTER (WHERE value > 50) AS c, count(*) AS n FROM events GROUP BY 1)
SELECT round(sum(c) / sum(n), 9) AS micro, round(avg(c / n), 9) AS macro, count(*) AS groups FROM g""")
def micro_macro_accuracy(spark, sf_dir):
    return rounded(R.micro_macro(read(spark, sf_dir, "events"), "event_type", F.coalesce(F.col("value") > 50, F.lit(False))), 9)


@query("""
SELECT round(sum(w * m), 6) AS overall FROM (SELECT o_orderpriority AS k, avg((0.7 * 2 + 0.2 * (o_orderkey % 3) + 0.1 * (o_custkey % 3)) / 2) AS m FROM orders GROUP BY 1)
JOIN (VALUES ('1-URGENT', 0.4), ('2-HIGH', 0.3), ('3-MEDIUM', 0.1), ('4-NOT SPECIFIED', 0.1), ('5-LOW', 0.1)) v(k, w) USING (k) HAVING count(*) = 5""")
def weighted_rollup(spark, sf_dir):
    w = {"1-URGENT": 0.4, "2-HIGH": 0.3, "3-MEDIUM": 0.1, "4-NOT SPECIFIED": 0.1, "5-LOW": 0.1}
    m = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg(R.wiscore(F.lit(2), F.col("o_orderkey") % 3, F.col("o_custkey") % 3)).alias("m"))
    out = rounded(R.weighted_overall(m, "o_orderpriority", "m", w))
    return out.where("overall IS NOT NULL")


@query("SELECT l_returnflag AS l1, l_linestatus AS l2, round(avg(l_discount), 9) AS mean, count(l_discount) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def hierarchy(spark, sf_dir):
    return rounded(R.two_levels(read(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_linestatus"), "l_discount"), 9)


@query("""
SELECT l_returnflag, round(avg(l_tax) FILTER (WHERE l_linestatus = 'F'), 9) AS F, round(avg(l_tax) FILTER (WHERE l_linestatus = 'O'), 9) AS O
FROM lineitem GROUP BY 1""")
def accuracy_pivot(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_tax")), 9)


@query("SELECT p_size, round(exp(avg(ln(p_retailprice))), 6) AS gmean FROM part GROUP BY p_size")
def gmean_by_size(spark, sf_dir):
    return rounded(read(spark, sf_dir, "part").groupBy("p_size").agg(R.geometric_mean(F.col("p_retailprice")).alias("gmean")))


_ASKED = f"SELECT l_orderkey, l_linenumber, (l_partkey % 3 > 0)::INT::DOUBLE AS score FROM ({_LINES})"


def _asked(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3 > 0).cast("int").cast("double").alias("score"), F.array(F.col("l_linenumber") - 1).alias("parents"))


@query(f"""WITH a AS ({_ASKED})
SELECT a.l_orderkey, a.l_linenumber, CASE WHEN p.score = 0 THEN 0.0 ELSE a.score END AS score
FROM a LEFT JOIN a p ON p.l_orderkey = a.l_orderkey AND p.l_linenumber = a.l_linenumber - 1""")
def dependency_plain(spark, sf_dir):
    return R.zero_dependents(_asked(spark, sf_dir), "l_orderkey", "l_linenumber", "parents", "score").select("l_orderkey", "l_linenumber", "score")


@query(f"""WITH a AS ({_ASKED}),
g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM a)
SELECT l_orderkey, l_linenumber, min(score) OVER (PARTITION BY l_orderkey, run ORDER BY l_linenumber) AS score FROM g""")
def dependency_cascade(spark, sf_dir):
    q = _asked(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("question"), "parents", "score"))).alias("qs"))
    done = q.select("l_orderkey", F.explode(R.zero_dependents_in_order(F.col("qs"))).alias("d"))
    return done.select("l_orderkey", F.col("d.question").alias("l_linenumber"), F.col("d.score").alias("score"))


@query("SELECT r AS item_id FROM range(0, 301) t(r) WHERE r NOT IN (SELECT item_id FROM benchmark)")
def missing_ids(spark, sf_dir):
    return R.missing_ids(read(spark, sf_dir, "benchmark"), "item_id", 0, 300)


@query("""
SELECT round(1 - least(100, avg(l_quantity)) * (1 - avg((l_returnflag = 'N')::INT)) * (1 - sum(l_linenumber) / sum(l_linenumber + 2)) / 100, 9) AS score FROM lineitem""")
def text_rollup(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    return rounded(l.agg(R.text_score(F.col("l_quantity"), (F.col("l_returnflag") == "N").cast("int"), F.col("l_linenumber"), F.col("l_linenumber") + 2, 100).alias("score")), 9)


@query("""
SELECT bucket::BIGINT AS bucket, round(sum(v), 4) AS total, count(v) AS n, round(avg(v), 6) AS mean
FROM (SELECT floor(l_partkey % 1100 / 100.0) AS bucket, l_discount AS v, l_partkey % 1100 AS t FROM lineitem) WHERE t < 1000 GROUP BY 1""")
def loss_buckets(spark, sf_dir):
    h = R.loss_histogram(read(spark, sf_dir, "lineitem").withColumn("t", F.col("l_partkey") % 1100), "t", "l_discount")
    return h.select("bucket", F.round("total", 4).alias("total"), "n", F.round("mean", 6).alias("mean"))


@query("""
SELECT e.vec_id, e.label, round(greatest(0, max(list_sum(list_transform(list_zip(e.embedding, r.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)))), 6) AS score
FROM embeddings e LEFT JOIN embeddings r ON e.label = r.label GROUP BY e.vec_id, e.label""")
def style_max_product(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return rounded(R.style_score_of_many(e, e, ["vec_id"], "embedding", "label"))


@query("""
SELECT o_orderkey, round_even(list_sum([CASE WHEN (o_orderkey + i) % 4 > 0 THEN [0.25, 0.5, 0.2, 0.05][i] ELSE 0.0 END FOR i IN [1, 2, 3, 4]]), 4)::DOUBLE AS semantic,
       ((o_orderkey % 4 = 9) AND true)::INT AS strict
FROM orders""")
def exam_scores(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    answers = F.array(*[((F.col("o_orderkey") + i) % 4 > 0).cast("int") for i in (1, 2, 3, 4)])
    s = R.exam_scores(F.array(*map(F.lit, (0.25, 0.5, 0.2, 0.05))), answers, F.lit(2), F.lit(2), F.lit(2))
    return o.select("o_orderkey", s.alias("s")).select("o_orderkey", "s.semantic", "s.strict")


# --- text and geometry ----------------------------------------------------------------------------------

def _documents(spark, sf_dir):
    """All documents; null text is as empty."""
    return read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


_TEXTS = "(SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)"


@query(f"""
SELECT doc_id, length(text) BETWEEN 200 AND 15000 AS length_ok,
       len(regexp_extract_all(' ' || regexp_replace(text, '[^\\pL\\pN_]', '  ', 'g') || ' ', '(?i)[^\\pL\\pN_]the[^\\pL\\pN_]')) AS n_the,
       regexp_matches(text, '\\p{{Nd}}{{2,}}') OR regexp_matches(lower(text), '{text.SPECIFICS}') AS specific,
       regexp_matches(lower(text), '{"|".join(text.LEAKS)}') OR len(regexp_extract_all(text, '\\{{[^}}]{{200,}}\\}}')) >= 2 AS leak
FROM {_TEXTS}""")
def trace_gates(spark, sf_dir):
    t = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id", text.length_within(t).alias("length_ok"), F.regexp_count(t, F.lit(r"(?i)\bthe\b")).alias("n_the"),
        text.specific(t).alias("specific"), text.leaks_reference(t).alias("leak"))


@query(f"""
WITH d AS (SELECT lang, doc_id, text, length(text) AS n, string_split(text, '. ') AS parts FROM {_TEXTS}),
s AS (SELECT lang, doc_id, CASE WHEN n BETWEEN 800 AND 4000 THEN 2.0 WHEN n BETWEEN 500 AND 6000 THEN 1.0 ELSE 0.0 END
      + least(len(regexp_extract_all(lower(text), 'bbox|position|coord')), 5) * 0.3 + least(len(regexp_extract_all(text, '\\p{{Nd}}{{2,}}')), 10) * 0.2
      + least(len(regexp_extract_all(lower(text), '{text.DECISIONS}')), 8) * 0.3
      + CASE WHEN len(parts) > 3 THEN len(list_distinct([lower(left(p, 30)) FOR p IN parts IF length(p) > 30])) / len(parts) * 2.0 ELSE 0.0 END AS score FROM d)
SELECT lang, doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, doc_id) <= 5""")
def reasoning_topk(spark, sf_dir):
    d = _documents(spark, sf_dir).withColumn("score", text.reasoning_score(F.col("text")))
    return rounded(R.top_k(d.select("lang", "doc_id", "score"), ["lang"], F.round("score", 9), ["doc_id"], 5))


# DuckDB counts edits of bytes: letters beyond ASCII become control characters, of which there are enough for the items' alphabet
@query("""
WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark),
m AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS a, left(array_to_string([chr(i) FOR i IN [1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31]], ''), count(*)) AS b FROM c WHERE ord(c) > 127),
t AS (SELECT item_id, translate(coalesce(text, ''), a, b) AS x FROM benchmark, m)
SELECT p.item_id AS a, q.item_id AS b, levenshtein(p.x, q.x) AS edits, round(coalesce(levenshtein(p.x, q.x) / nullif(greatest(length(p.x), length(q.x)), 0), 0), 6) AS share
FROM t p JOIN t q ON p.item_id + 1 = q.item_id""")
def edit_distance(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("x")).join(b.select(F.col("item_id").alias("b"), F.col("text").alias("y")), F.expr("a + 1 = b"))
    return pairs.select("a", "b", F.levenshtein("x", "y").alias("edits"), F.round(text.edit_share(F.col("x"), F.col("y")), 6).alias("share"))


@query("""
WITH p AS (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON a.item_id + 1 = b.item_id),
x AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(x, '\\S+')) AS w FROM p) GROUP BY ALL),
y AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(y, '\\S+')) AS w FROM p) GROUP BY ALL)
SELECT x.item_id, sum(least(x.n, coalesce(y.n, 0)))::INT AS matched, round(sum(least(x.n, coalesce(y.n, 0))) / sum(x.n), 6) AS ratio
FROM x LEFT JOIN y USING (item_id, w) GROUP BY 1""")
def multiset_match(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("y"))
    m = b.join(nxt, "item_id").select("item_id", text.multiset_match(F.col("text"), F.col("y")).alias("m"))
    return m.select("item_id", "m.matched", F.round("m.ratio", 6).alias("ratio"))


_BOXES = """b AS (SELECT l_orderkey, l_linenumber, l_partkey % 500 AS x1, l_suppkey % 400 AS y1,
  l_partkey % 500 + 20 + (l_quantity * 5)::INT AS x2, l_suppkey % 400 + 30 + (l_quantity * 3)::INT AS y2 FROM lineitem)"""


def _boxes(spark, sf_dir):
    q = F.col("l_quantity")
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") % 400
    box = F.array(*[c.cast("int") for c in (x, y, x + 20 + F.round(q * 5).cast("int"), y + 30 + F.round(q * 3).cast("int"))])
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))


@query(f"""WITH {_BOXES}, p AS (
  SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
         (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
  FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, a, b, round(i / (s - i), 9) AS iou FROM p""")
def iou_pairs(spark, sf_dir):
    p = R.unordered_pairs(_boxes(spark, sf_dir), "l_orderkey", "l_linenumber", "box")
    return p.select("l_orderkey", "a", "b", F.round(geometry.iou(F.col("a_value"), F.col("b_value")), 9).alias("iou"))


@query("""
SELECT l_orderkey, l_linenumber FROM (SELECT *, (l_quantity + 1) / (l_linenumber * 6) AS av, l_tax * 25 + 0.1 AS cv FROM lineitem)
WHERE NOT ((av > 1.05 AND cv < 0.95) OR (av < 0.95 AND cv > 1.05))""")
def ratio_flip(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    return l.where(~geometry.flipped(F.col("l_quantity") + 1, F.col("l_linenumber") * 6, F.col("l_tax") * 25 + 0.1)).select("l_orderkey", "l_linenumber")


_WHOLE = lambda x: f"least(greatest(greatest(32, round_even(({x}) / 32, 0) * 32), 256), 16384)"
_REFINED = "".join(f""",
s{i} AS (SELECT p_partkey, {_WHOLE('w * k')} AS w, {_WHOLE('h * k')} AS h FROM (SELECT *, CASE WHEN w * h < 1048576 * 0.95 THEN sqrt(1048576 * 0.95 / greatest(w * h, 1)) WHEN w * h > 1048576 * 1.05 THEN sqrt(1048576 * 1.05 / greatest(w * h, 1)) END AS k FROM s{i - 1}) WHERE k IS NOT NULL
  UNION ALL SELECT p_partkey, w, h FROM s{i - 1} WHERE w * h BETWEEN 1048576 * 0.95 AND 1048576 * 1.05)""" for i in range(1, 9))


@query(f"""
WITH s0 AS (SELECT p_partkey, {_WHOLE('sqrt(1048576 * r)')} AS w, {_WHOLE('sqrt(1048576 * r) / r')} AS h FROM (SELECT p_partkey, p_size / (p_partkey % 9 + 1) AS r FROM part)){_REFINED}
SELECT p_partkey, w::INT AS width, h::INT AS height FROM s8""")
def bucket_sizes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", geometry.bucket_size(F.col("p_size") / (F.col("p_partkey") % 9 + 1), 1024).alias("s"))
    return p.select("p_partkey", F.col("s.w").cast("int").alias("width"), F.col("s.h").cast("int").alias("height"))


@query("""
WITH a AS (SELECT p_partkey, p_size AS v, least(8, p_size) AS k FROM part),
b AS (SELECT *, list_transform(range(0, k + 1), lambda i: CASE WHEN i = k THEN v ELSE floor(i * (v / k)) END) AS ends FROM a)
SELECT p_partkey, list_transform(range(0, 8), lambda i: floor((ends[least(i, k - 1) + 1] + ends[least(i, k - 1) + 2] - 1) / 2)::INT)::VARCHAR AS middle,
       list_transform(range(0, 8), lambda i: ends[least(i, k - 1) + 1]::INT)::VARCHAR AS start FROM b""")
def video_frames(spark, sf_dir):
    show = lambda how: F.concat(F.lit("["), F.array_join(geometry.frame_places(F.col("p_size"), 8, how), ", "), F.lit("]"))
    return read(spark, sf_dir, "part").select("p_partkey", show("middle").alias("middle"), show("start").alias("start"))


@query("""
WITH b AS (SELECT p_partkey, p_size % 5 + 1 AS h, p_partkey % 6 + 1 AS w, p_size / 64.0 AS x1, p_size / 100.0 AS y1, p_size / 64.0 + 0.3 AS x2, p_size / 100.0 + 0.2 AS y2 FROM part),
c AS (SELECT *, unnest(range(0, h * w)) AS i FROM b)
SELECT p_partkey, count(*) FILTER (WHERE NOT (greatest(x1, (i % w) / w) < least(x2, (i % w + 1) / w) AND greatest(y1, (i // w) / h) < least(y2, (i // w + 1) / h))) AS open, count(*) AS n
FROM c GROUP BY p_partkey""")
def masked_patches(spark, sf_dir):
    s = F.col("p_size")
    box = F.array(s / 64.0, s / 100.0, s / 64.0 + 0.3, s / 100.0 + 0.2)
    w = geometry.patch_weights(F.array(box), s % 5 + 1, (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", w.alias("w")).select(
        "p_partkey", F.size(F.filter("w", lambda x: x == 1)).cast("long").alias("open"), F.size("w").cast("long").alias("n"))


# --- ranking, packing, conversations --------------------------------------------------------------------


@query("""
WITH p AS (SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b,
  (CASE WHEN a.l_partkey % 5 = 0 THEN 0.5 WHEN a.l_quantity > b.l_quantity THEN 0.95 ELSE 0.05 END + 1
   - CASE WHEN b.l_quantity > a.l_quantity THEN 0.95 WHEN b.l_quantity = a.l_quantity THEN 0.5 ELSE 0.05 END) / 2 AS y
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, a, b, round(y, 6) AS y, CASE WHEN round(y, 6) > 0.5 THEN 'A' WHEN round(y, 6) < 0.5 THEN 'B' ELSE 'TIE' END AS winner FROM p""")
def pair_symmetrise(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_partkey", "l_quantity").alias("v"))
    p = R.unordered_pairs(l, "l_orderkey", "l_linenumber", "v")
    qa, qb = F.col("a_value.l_quantity"), F.col("b_value.l_quantity")
    fwd = F.when(F.col("a_value.l_partkey") % 5 != 0, F.when(qa > qb, 0.95).otherwise(0.05))
    y = F.round(R.symmetric(fwd, F.when(qb > qa, 0.95).when(qb != qa, 0.05)), 6)
    return p.select("l_orderkey", "a", "b", y.alias("y"), R.winner(y).alias("winner"))


@query("""
SELECT l_orderkey, min(l_returnflag) AS choice FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 2 AND min(l_returnflag) = max(l_returnflag)""")
def judge_agree(spark, sf_dir):
    """Orders with lines of both statuses, which are the judges, and one return flag in all of them."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", F.col("l_returnflag").alias("choice"))
    return R.agreeing(l, "l_orderkey", "l_linestatus", "choice", 2)


@query("""
SELECT l_orderkey, count(*) AS n_done, sum(ok) AS n_valid FROM (SELECT l_orderkey, l_linenumber, max((l_returnflag <> 'R')::INT) AS ok FROM lineitem GROUP BY ALL)
GROUP BY 1 HAVING count(*) >= 4 AND sum(ok) >= 2""")
def completion_emit(spark, sf_dir):
    return R.completed(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") != "R", 4)


@query("""
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag <> 'R' THEN l_discount ELSE '-inf'::DOUBLE END DESC, l_returnflag <> 'R' DESC, l_linenumber)::INT AS rank
FROM lineitem""")
def candidate_rank(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").withColumn("valid", F.col("l_returnflag") != "R")
    return R.ranked(l, "l_orderkey", "l_discount", "valid", "l_linenumber").select("l_orderkey", "l_linenumber", "rank")


@query()
def pairwise_ratings(spark, sf_dir):
    return rounded(D.rate_groups(pair_symmetrise(spark, sf_dir), "l_orderkey"))


@query()
def pack_greedy(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 500).alias("shard"), "doc_id", (F.floor(F.col("n_chars") / 4) + 4).cast("int").alias("cost"))
    return D.pack_shards(d, "shard", "doc_id", "cost")


@query("""
SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS packed FROM conversations GROUP BY conv_id""")
def chat_pack(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("t")))).alias("ts"))
    return c.select("conv_id", "n_turns", F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("packed"))


@query("""
SELECT event_id, props AS canonical, replace(replace(props, chr(39), chr(92) || chr(39)), chr(34), chr(39)) AS single_quoted
FROM (SELECT event_id, replace(replace(props, ': ', ':'), ', ', ',') AS props FROM events)""")
def canonical_props(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", D.mapped(F.col("props"), D.canonical).alias("canonical"), D.mapped(F.col("props"), D.single_quoted).alias("single_quoted"))


# --- packed sequences -----------------------------------------------------------------------------------

_SEGMENTS = """g AS (
  SELECT l_orderkey AS pack, l_linenumber // 3 AS sample, l_linenumber AS place,
         CASE l_linenumber % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'vit' ELSE 'vae' END AS kind,
         max(l_quantity)::BIGINT AS length, max(l_returnflag) = 'R' AS loss, min(l_discount) < 0.02 AS dropped
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
c AS (SELECT *, CASE WHEN dropped THEN 0 ELSE length + 2 END AS tokens FROM g),
l AS (SELECT *, (coalesce(sum(tokens) OVER (PARTITION BY pack ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
         (coalesce(sum(CASE WHEN kind = 'text' THEN tokens WHEN dropped THEN 1 WHEN kind = 'vae' AND loss THEN 0 ELSE 1 END)
           OVER (PARTITION BY pack, sample ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rope FROM c)"""


def _laid(spark, sf_dir):
    n = F.col("l_linenumber")
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pack"), n.alias("place")).agg(
        F.max("l_quantity").cast("long").alias("length"), (F.max("l_returnflag") == "R").alias("loss"), (F.min("l_discount") < 0.02).alias("dropped"))
    third = F.col("place") % 3
    g = g.select("*", F.floor(F.col("place") / 3).alias("sample"), F.when(third == 0, "text").when(third == 1, "vit").otherwise("vae").alias("kind"))
    return Q.layout(g, "pack", "sample", "place")


@query(f"""WITH {_SEGMENTS}
SELECT pack, place, kind, start, tokens, rope, CASE WHEN kind = 'text' THEN 'causal' WHEN kind = 'vae' AND loss THEN 'noise' ELSE 'full' END AS attention,
       CASE WHEN NOT loss OR kind = 'vit' THEN 0 WHEN kind = 'text' THEN length + 1 ELSE length END AS loss_tokens
FROM l WHERE NOT dropped""")
def sequence_layout(spark, sf_dir):
    return _laid(spark, sf_dir).select("pack", "place", "kind", "start", "tokens", "rope", "attention", "loss_tokens")


@query(f"""WITH {_SEGMENTS},
t AS (SELECT pack, start, rope, kind, length, loss, unnest(range(0, tokens)) AS i FROM l WHERE NOT dropped),
b AS (SELECT pack, start + i AS position, rope + CASE WHEN kind = 'text' THEN i ELSE 0 END AS rope,
      CASE WHEN loss AND kind = 'text' AND i <= length THEN 'ce' WHEN loss AND kind = 'vae' AND i BETWEEN 1 AND length THEN 'mse' END AS loss_kind FROM t)
SELECT pack, count(*) AS n, max(position) AS last, sum(rope)::BIGINT AS ropes, count(*) FILTER (WHERE loss_kind = 'ce') AS ce, count(*) FILTER (WHERE loss_kind = 'mse') AS mse FROM b GROUP BY pack""")
def token_positions(spark, sf_dir):
    t = Q.token_places(_laid(spark, sf_dir), "pack")
    return t.groupBy("pack").agg(
        F.count(F.lit(1)).alias("n"), F.max("position").alias("last"), F.sum("rope").alias("ropes"),
        F.count_if(F.col("loss_kind") == "ce").alias("ce"), F.count_if(F.col("loss_kind") == "mse").alias("mse"))


@query(f"""WITH {_SEGMENTS},
r AS (SELECT pack, kind, start, start + tokens AS stop FROM l WHERE tokens > 0),
e AS (SELECT event_id % 1000 AS pack, user_id % 120 AS position, value FROM events WHERE value IS NOT NULL)
SELECT kind AS dataset, count(*) AS n, round(sum(value), 4) AS total FROM e JOIN r ON e.pack = r.pack AND position >= start AND position < stop GROUP BY kind""")
def loss_by_dataset(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("pack"), (F.col("user_id") % 120).alias("position"), "value")
    return rounded(Q.loss_by_dataset(e, _laid(spark, sf_dir), "pack", "position", "value", "place", "kind", "tokens"), 4)


@query("""
SELECT p_partkey, list_transform(range(0, (p_size // 2) * 3), lambda i: ((i // 3) * 8 + i % 3)::INT)::VARCHAR AS corner,
       list_transform(range(0, (p_size // 2) * 3), lambda i: (((i // 3) * 8 // (p_size // 2)) * 8 + (i % 3) * 8 // 3)::INT)::VARCHAR AS spread,
       round(CASE WHEN p_size // 2 = 0 THEN 0 ELSE 1 / sqrt(p_size // 2) END, 6) AS weight
FROM part""")
def grid_positions(spark, sf_dir):
    p, tall = read(spark, sf_dir, "part"), F.floor(F.col("p_size") / 2)
    grid = lambda **k: F.concat(F.lit("["), F.array_join(Q.grid_positions(F.col("p_size"), F.lit(6), 2, 8, **k), ", "), F.lit("]"))
    return p.select("p_partkey", grid().alias("corner"), grid(stretched=True).alias("spread"), F.round(Q.length_weight(tall), 6).alias("weight"))


# --- queues ---------------------------------------------------------------------------------------------


@query("SELECT event_id FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) >= 86400")
def stale_claims(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    return queues.stale(e.crossJoin(F.broadcast(now)), F.col("ts"), F.col("now"), 86400).select("event_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def queue_depth(spark, sf_dir):
    return queues.depth(read(spark, sf_dir, "events"), "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def hourly_windows(spark, sf_dir):
    return rounded(queues.windowed(read(spark, sf_dir, "events"), "ts", "event_type", "value"))
