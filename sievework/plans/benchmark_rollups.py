"""Queries of benchmark roll-ups, robust statistics and joins with dimensions over the supplied tables; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import benchmarks as B
from sievework.operators import relational as R
from sievework.operators import statistics as S
from sievework.plans.catalog import _LINES, _lines, query, read, rounded

# --- exams, skills, checklists --------------------------------------------------------------------------

_EXAM = """x AS (SELECT o_orderpriority AS subject, o_orderkey, [(o_orderkey + i) % 9 > 0 FOR i IN [1, 2, 3, 4]] AS a, CASE WHEN o_custkey % 5 > 0 THEN 2 ELSE o_custkey % 3 END AS spelling,
  CASE WHEN o_custkey % 7 > 0 THEN 2 ELSE 1 END AS readability, CASE WHEN o_orderkey % 11 > 0 THEN 2 ELSE 0 END AS logic FROM orders),
y AS (SELECT *, round_even(list_sum([CASE WHEN a[i] THEN [0.25, 0.5, 0.2, 0.05][i] ELSE 0.0 END FOR i IN [1, 2, 3, 4]]), 4)::DOUBLE AS semantic,
  (a[1] AND a[2] AND a[3] AND a[4] AND spelling = 2 AND readability = 2 AND logic = 2)::INT AS strict FROM x),
z AS (SELECT *, round(0.7 * semantic + 0.05 * (spelling + readability + logic), 9) AS relaxed FROM y)"""


def _exams(spark, sf_dir):
    o, k, c = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    answers = F.array(*[((k + i) % 9 > 0).cast("int") for i in (1, 2, 3, 4)])
    s = R.exam_scores(F.array(*map(F.lit, (0.25, 0.5, 0.2, 0.05))), answers, F.when(c % 5 > 0, 2).otherwise(c % 3), F.when(c % 7 > 0, 2).otherwise(1), F.when(k % 11 > 0, 2).otherwise(0))
    return o.select(F.col("o_orderpriority").alias("subject"), "o_orderkey", s.alias("s")).select("subject", "o_orderkey", "s.*")


@query(f"""WITH {_EXAM}
SELECT subject, count(*) AS n, round(avg(semantic), 6) AS semantic, round(avg(strict), 6) AS strict, round(avg(round_even(relaxed, 3)), 4) AS relaxed FROM z GROUP BY ROLLUP (subject)""")
def exam_rollup(spark, sf_dir):
    r = B.exam_rollup(_exams(spark, sf_dir), "subject", ["semantic", "strict", "relaxed"])
    return r.select("subject", "n", F.round("semantic", 6).alias("semantic"), F.round("strict", 6).alias("strict"), F.round("relaxed", 4).alias("relaxed"))


_SKILL = f"""(SELECT l_orderkey, l_linenumber, ['object', 'attribute', 'count', 'position', 'verb'][l_partkey % 5 + 1] AS skill, l_quantity / 50 AS score,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM ({_LINES}))"""


@query(f"SELECT skill, round(100 * avg(score), 6) AS mean, count(*) AS n FROM {_SKILL} WHERE nth <= 3 GROUP BY skill")
def skill_means(spark, sf_dir):
    l = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("ls"))
    word = F.array(*map(F.lit, ("object", "attribute", "count", "position", "verb")))
    names = l.select("l_orderkey", F.transform("ls", lambda x: F.element_at(word, (x["l_partkey"] % 5 + 1).cast("int"))).alias("skill"))
    scores = l.select("l_orderkey", F.slice(F.transform("ls", lambda x: x["l_quantity"] / 50), 1, 3).alias("score"))
    return rounded(B.skill_means(B.zipped(scores, names, "l_orderkey", "score", "skill"), "skill", "score"))


@query(f"""
WITH i AS (SELECT l_orderkey, avg(CASE l_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 END) AS m FROM ({_LINES}) GROUP BY 1)
SELECT round(avg(m), 9) AS mean, count(m) AS items FROM i""")
def checklist_mean(spark, sf_dir):
    p = F.col("l_partkey") % 4
    answer = F.when(p == 0, "well, yes").when(p == 1, "no.").when(p == 2, "no? yes!").otherwise("eyes and noses")
    return rounded(B.checklist_mean(_lines(spark, sf_dir), "l_orderkey", B.yes_no_score(answer)), 9)


@query("""
WITH g AS (SELECT l_shipmode AS m, l_linenumber AS n, avg((l_quantity > 25)::INT) AS a FROM (SELECT l_suppkey % 7 AS l_shipmode, * FROM lineitem WHERE l_linenumber <= 3) GROUP BY ALL)
SELECT m, round(max(a) FILTER (WHERE n = 1), 9) AS c1, round(max(a) FILTER (WHERE n = 2), 9) AS c2, round(max(a) FILTER (WHERE n = 3), 9) AS c3, round(avg(a), 9) AS mean FROM g GROUP BY m""")
def accuracy_table(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select((F.col("l_suppkey") % 7).alias("m"), F.concat(F.lit("c"), "l_linenumber").alias("c"), "l_quantity")
    return rounded(B.accuracy_table(l, ["m"], "c", ["c1", "c2", "c3"], F.col("l_quantity") > 25), 9)


@query("""
WITH a AS (SELECT n_name, n_regionkey, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
g AS (SELECT r_name AS grp, avg(m) AS mean, count(*) AS attributes FROM a JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT grp, round(mean, 6) AS mean, attributes FROM g UNION ALL SELECT NULL, round(avg(mean), 6), sum(attributes)::BIGINT FROM g""")
def hierarchy_means(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    c = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_acctbal")
    dim = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("grp"))
    return rounded(B.hierarchy_means(c, dim, "n_name", "grp", "c_acctbal"))


@query("""
WITH p AS (SELECT l_orderkey, max((l_quantity > 40)::INT) AS any_, sum((l_quantity > 40)::INT) AS c, count(*) AS n FROM lineitem GROUP BY 1)
SELECT round(sum(c) / sum(n), 9) AS images, round(avg(any_), 9) AS prompts, sum(n)::BIGINT AS n_images, count(*) AS n_prompts FROM p""")
def any_correct(spark, sf_dir):
    return rounded(B.any_correct(read(spark, sf_dir, "lineitem").withColumn("ok", F.col("l_quantity") > 40), "l_orderkey", "ok"), 9)


@query(f"""
WITH l AS ({_LINES}), p AS (SELECT a.l_orderkey, avg(abs(a.l_quantity - b.l_quantity)) AS d FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1)
SELECT o_orderpriority AS kind, round(avg(d), 6) AS mean, count(*) AS n FROM p JOIN orders ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderpriority)""")
def pair_diversity(spark, sf_dir):
    pairs = R.unordered_pairs(_lines(spark, sf_dir), "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", F.abs(F.col("a_value") - F.col("b_value")).alias("d"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("kind"))
    return rounded(B.pair_diversity(pairs.join(o, "l_orderkey"), ["l_orderkey"], "kind", "d"))


@query("""
SELECT round(avg(v) FILTER (WHERE lang = 'en'), 6) AS english, count(v) FILTER (WHERE lang = 'en') AS n_english, round(avg(v) FILTER (WHERE n_chars < 1000), 6) AS short, count(v) FILTER (WHERE n_chars < 1000) AS n_short,
       round(avg(v) FILTER (WHERE lang = 'none'), 6) AS nowhere, count(v) FILTER (WHERE lang = 'none') AS n_nowhere
FROM (SELECT doc_id, quality * 0.7 + toxic * 0.3 AS v FROM labels) JOIN documents USING (doc_id)""")
def conditional_means(spark, sf_dir):
    s = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 0.7 + F.col("toxic") * 0.3).alias("v"))
    facts = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return rounded(B.conditional_means(s, facts, ["doc_id"], "v", {"english": F.col("lang") == "en", "short": F.col("n_chars") < 1000, "nowhere": F.col("lang") == "none"}))


@query("SELECT o_orderpriority AS kind, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice / 1000 END AS v FROM orders) GROUP BY 1")
def mean_similarity(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderkey") % 6 > 0, F.col("o_totalprice") / 1000).alias("v"))
    return rounded(B.mean_similarity(o, ["kind"], "v"))


_JUDGED = """p AS (SELECT o_orderstatus AS judge, CASE o_custkey % 40 WHEN 0 THEN 'st_l10' WHEN 1 THEN 'full' WHEN 2 THEN 'no_bbox' ELSE 'x' || o_custkey % 40 END AS name, avg(o_totalprice) / 1000 AS x, avg(o_orderkey) AS y FROM orders GROUP BY ALL)"""


@query(f"""WITH {_JUDGED}
SELECT judge, count(*) AS n, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(max(x) FILTER (WHERE name = 'st_l10'), 6) AS x_top,
       coalesce(abs(max(x) FILTER (WHERE name = 'st_l10') - max(x)) < 0.5, false) AS top_is_greatest,
       round(max(x) FILTER (WHERE name = 'no_bbox') - max(x) FILTER (WHERE name = 'full'), 6) AS direction, round(regr_slope(y, x), 4) AS slope, round(corr(x, y), 6) AS r
FROM p GROUP BY judge HAVING count(*) >= 6""")
def judge_summary(spark, sf_dir):
    c = F.col("o_custkey") % 40
    name = F.when(c == 0, "st_l10").when(c == 1, "full").when(c == 2, "no_bbox").otherwise(F.concat(F.lit("x"), c.cast("string")))
    p = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("judge"), name.alias("name")).agg((F.avg("o_totalprice") / 1000).alias("x"), F.avg("o_orderkey").alias("y"))
    s = B.judge_summary(p, "judge", "name", "x", "y")
    cols = [F.round(k, 6).alias(k) for k in ("x_min", "x_max", "x_top", "direction", "r")]
    return s.select("judge", "n", "top_is_greatest", F.round("slope", 4).alias("slope"), *cols)


@query("""
WITH o AS (SELECT o_custkey AS i, o_orderpriority AS mode, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 97) / 10.0 END AS score FROM orders)
SELECT 'mode' AS counter, mode AS name, count(*) AS n FROM o GROUP BY mode
UNION ALL SELECT 'score', printf('%.1f', score), count(*) FROM o WHERE score IS NOT NULL GROUP BY 2 UNION ALL SELECT 'indices', NULL, count(DISTINCT i) FROM o""")
def run_counters(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("i"), F.col("o_orderpriority").alias("mode"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 97) / 10.0).alias("score"))
    return B.counters(o, "i", "mode", "score")


@query(f"SELECT l_orderkey % 3 AS kind, count(*)::BIGINT AS questions, count(DISTINCT l_orderkey) AS rows FROM ({_LINES}) GROUP BY 1")
def question_counts(spark, sf_dir):
    q = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("qs"))
    return B.question_counts(q.withColumn("kind", F.col("l_orderkey") % 3), ["kind"], "qs")


@query("""
WITH g AS (SELECT event_type AS k, event_id // 100 AS round, sum(value) AS total, sum(user_id % 9 + 1) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT k, round, round(total, 4) AS total, n::BIGINT AS n, round(total / n, 6) AS mean, sum(n) OVER (PARTITION BY k ORDER BY round)::BIGINT AS n_so_far FROM g""")
def reduced_losses(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("k"), F.floor(F.col("event_id") / 100).alias("round"), "value", (F.col("user_id") % 9 + 1).alias("m"))
    r = B.reduced(e, ["k", "round"], "value", "m", "round")
    return r.select("k", "round", F.round("total", 4).alias("total"), "n", F.round("mean", 6).alias("mean"), "n_so_far")


# --- joins ----------------------------------------------------------------------------------------------


@query("""
SELECT kind, level, run, round(v, 6) AS value, round(loss, 6) AS loss FROM (SELECT l_returnflag AS kind, l_linestatus AS level, avg(l_tax) AS v FROM lineitem GROUP BY ALL)
JOIN (VALUES ('A', 'F', 'P'), ('N', 'O', 'O'), ('R', 'F', 'F'), ('N', 'F', 'X')) m(kind, level, run) USING (kind, level)
JOIN (SELECT o_orderstatus AS run, avg(o_totalprice) AS loss FROM orders GROUP BY 1) USING (run) WHERE run <> 'O'""")
def cell_losses(spark, sf_dir):
    cells = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("level")).agg(F.avg("l_tax").alias("value"))
    runs = spark.createDataFrame([("A", "F", "P"), ("N", "O", "O"), ("R", "F", "F"), ("N", "F", "X")], "kind string, level string, run string")
    losses = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("run")).agg(F.avg("o_totalprice").alias("loss"))
    return rounded(B.cells_with_losses(cells, losses, runs, ["O"])).select("kind", "level", "run", "value", "loss")


@query("SELECT o_orderkey // 64 AS shard_id, o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def shard_lookup(spark, sf_dir):
    want = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return B.shard_lookup(want, read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 64)


@query("""
SELECT category, count(*) AS n, round(avg(score), 6) AS score FROM (SELECT CASE WHEN i BETWEEN 1 AND 400 THEN 'CULTURE' WHEN i BETWEEN 401 AND 567 THEN 'TIME' WHEN i BETWEEN 568 AND 700 THEN 'SPACE'
  WHEN i BETWEEN 701 AND 800 THEN 'BIOLOGY' WHEN i BETWEEN 801 AND 900 THEN 'PHYSICS' WHEN i BETWEEN 901 AND 1000 THEN 'CHEMISTRY' END AS category, (0.7 * (i % 3) + 0.2 * 1 + 0.1 * 2) / 2 AS score
  FROM (SELECT o_custkey % 1100 AS i FROM orders)) GROUP BY 1""")
def world_categories(spark, sf_dir):
    i = F.col("o_custkey") % 1100
    o = read(spark, sf_dir, "orders").select(B.range_category(i, B.WORLD_RANGES).alias("category"), R.wiscore(i % 3, F.lit(1), F.lit(2)).alias("score"))
    return rounded(B.mean_similarity(o, ["category"], "score").select("category", "n", F.col("mean").alias("score")))


# --- statistics -----------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, round(p_retailprice ** 2 / m, 4) AS squared, round(exp(least(p_retailprice, 6000) / 60.0) - 1, 2) / 1e30 AS exp_, round((p_retailprice / m) ** 2, 6) AS power_2_0, round((p_retailprice / m) ** 3, 6) AS power_3_0,
       round(CASE WHEN p_retailprice % 260 < 220 THEN -ln(1 - (p_retailprice % 260) / 220) END, 6) AS capacity_220, round(CASE WHEN p_retailprice % 260 < 250 THEN -ln(1 - (p_retailprice % 260) / 250) END, 6) AS capacity_250
FROM part, (SELECT avg(p_retailprice) AS m FROM part)""")
def metric_transforms(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    c = S.candidates(p, "p_retailprice")
    low = S.candidates(p.select("p_partkey", (F.col("p_retailprice") % 260).alias("g")), "g").select("p_partkey", "capacity_220", "capacity_250")
    return c.drop("capacity_220", "capacity_250").join(low, "p_partkey").select(
        "p_partkey", F.round("squared", 4).alias("squared"), (F.round("exp", 2) / 1e30).alias("exp_"), F.round("power_2_0", 6).alias("power_2_0"), F.round("power_3_0", 6).alias("power_3_0"),
        F.round("capacity_220", 6).alias("capacity_220"), F.round("capacity_250", 6).alias("capacity_250"))


_U = lambda key: f"('0x' || left(sha256({key}), 13))::BIGINT / 4503599627370496.0"

_DRAWN = f"""t AS (SELECT o_custkey % 200 AS unit, o_orderpriority AS cell, avg(o_totalprice) AS x FROM orders GROUP BY ALL),
un AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS number, count(*) OVER () AS size FROM (SELECT DISTINCT unit FROM t)),
dr AS (SELECT b, least(floor({_U("b::VARCHAR || '|' || k::VARCHAR")} * s.size)::BIGINT, s.size - 1) AS number FROM range(0, 40) r(b), (SELECT max(size) AS size FROM un) s, range(0, 200) q(k) WHERE k < s.size),
pk AS (SELECT b, cell, x FROM dr JOIN un USING (number) JOIN t USING (unit)),
rk AS (SELECT *, row_number() OVER (PARTITION BY b, cell ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY b, cell) AS n FROM pk),
tr AS (SELECT b, cell, avg(x) FILTER (WHERE n <= 2 * greatest(1, n // 5) OR (i >= greatest(1, n // 5) AND i < n - greatest(1, n // 5))) AS f FROM rk GROUP BY ALL),
pt AS (SELECT b, f, t FROM tr JOIN (SELECT o_orderpriority AS cell, avg(o_orderkey) AS t FROM orders GROUP BY 1) USING (cell)),
rr AS (SELECT b, f, t, rank() OVER (PARTITION BY b ORDER BY f) AS rf, rank() OVER (PARTITION BY b ORDER BY t) AS rt FROM pt),
rh AS (SELECT b, corr(rf, rt) AS rho FROM rr GROUP BY b),
iv AS (SELECT p.b, count(*) FILTER (WHERE p.t < q.t) AS inversions FROM pt p JOIN pt q ON p.b = q.b AND p.f < q.f GROUP BY p.b)"""


def _replicates(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("unit", F.col("o_custkey") % 200)
    goal = o.groupBy("o_orderpriority").agg(F.avg("o_orderkey").alias("t"))
    return S.bootstrap(o, "unit", ["o_orderpriority"], "o_totalprice", goal, "t", replicates=40)


@query(f"WITH {_DRAWN} SELECT b AS replicate, round(rho, 6) AS rho, inversions FROM rh JOIN iv USING (b)")
def bootstrap_replicates(spark, sf_dir):
    return rounded(_replicates(spark, sf_dir))


@query(f"""WITH {_DRAWN}, s AS (SELECT list_sort(list(rho)) AS r FROM rh)
SELECT (SELECT count(*) FROM rh) AS n, (SELECT round(avg(rho), 6) FROM rh) AS mean, (SELECT round(stddev_samp(rho), 6) FROM rh) AS sd, (SELECT round(avg(inversions), 6) FROM iv) AS mean_inversions,
       (SELECT round(avg((rho < -0.9)::INT), 6) FROM rh) AS below_90, (SELECT round(avg((rho < -0.93)::INT), 6) FROM rh) AS below_93, (SELECT round(avg((rho < -0.95)::INT), 6) FROM rh) AS below_95,
       round(r[21], 6) AS median, round(r[2], 6) AS low95, round(r[40], 6) AS high95, round(r[1], 6) AS low99, round(r[40], 6) AS high99 FROM s""")
def bootstrap_interval(spark, sf_dir):
    return rounded(S.bootstrap_summary(_replicates(spark, sf_dir)))


@query(f"""
WITH v AS (SELECT o_orderstatus || '/' || o_orderpriority AS cell, o_totalprice AS x FROM orders WHERE o_orderkey < 400 AND o_totalprice IS NOT NULL),
r AS (SELECT cell, x, row_number() OVER (PARTITION BY cell ORDER BY x) - 1 AS rank, count(*) OVER (PARTITION BY cell) AS n FROM v),
d AS (SELECT c.cell, b, least(floor({_U("'se|' || c.cell || '|' || b::VARCHAR || '|' || k::VARCHAR")} * c.n)::BIGINT, c.n - 1) AS rank
      FROM (SELECT DISTINCT cell, n FROM r WHERE n >= 4) c, range(0, 30) t(b), range(0, 400) q(k) WHERE k < c.n),
p AS (SELECT d.cell, b, x, row_number() OVER (PARTITION BY d.cell, b ORDER BY x) - 1 AS i, n FROM d JOIN r ON d.cell = r.cell AND d.rank = r.rank),
m AS (SELECT cell, b, avg(x) FILTER (WHERE n <= 2 * greatest(1, n // 5) OR (i >= greatest(1, n // 5) AND i < n - greatest(1, n // 5))) AS f FROM p GROUP BY ALL)
SELECT s.cell, s.n, round(coalesce(e.se, 0), 4) AS se FROM (SELECT DISTINCT cell, n FROM r) s LEFT JOIN (SELECT cell, stddev_samp(f) AS se FROM m GROUP BY 1) e USING (cell)""")
def bootstrap_errors(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderkey < 400").select(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("cell"), "o_totalprice")
    return rounded(S.bootstrap_se(o, ["cell"], "o_totalprice", 30), 4)


@query("""
WITH n AS (SELECT event_type AS kind, event_id % 10 AS level, user_id % 5 + 3 AS n, value / 100 AS prior, value / 300 AS grounded FROM events WHERE value IS NOT NULL)
SELECT kind, level, count(*) AS n, round(avg(prior - grounded), 6) AS gpg, round(coalesce(stddev_samp(prior - grounded) / sqrt(count(*)), 0), 6) AS se, round(sum((prior - grounded) * n), 4) AS total FROM n GROUP BY ALL""")
def grounding_gain(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("kind"), (F.col("event_id") % 10).alias("level"), (F.col("user_id") % 5 + 3).alias("n_tokens"), (F.col("value") / 100).alias("prior"), (F.col("value") / 300).alias("grounded"))
    g = S.grounding_gain(e, ["kind", "level"], "prior", "grounded", "n_tokens")
    return g.select("kind", "level", "n", F.round("gpg", 6).alias("gpg"), F.round("se", 6).alias("se"), F.round("total", 4).alias("total"))


# --- detections -----------------------------------------------------------------------------------------


@query()
def spec_evaluation(spark, sf_dir):
    """Pictures made of orders: boxes of two classes by line, with wishes about counts, colours and places."""
    q, p = F.col("l_quantity"), F.col("l_partkey")
    x = (p % 300).cast("double")
    box = F.struct(x.alias("x1"), (p % 200).cast("double").alias("y1"), (x + 20 + q).alias("x2"), (p % 200 + 30 + q).alias("y2"), (q / 50).alias("score"), F.element_at(F.array(*map(F.lit, B.COLOURS)), (p % 10 + 1).cast("int")).alias("colour"))
    l = _lines(spark, sf_dir).select("l_orderkey", F.when(p % 2 == 0, "cat").otherwise("dog").alias("c"), F.struct((-q).alias("o"), "l_linenumber", box.alias("box")).alias("b"))
    found = l.groupBy("l_orderkey", "c").agg(F.sort_array(F.collect_list("b")).alias("bs")).groupBy("l_orderkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("c", F.transform("bs", lambda b: b["box"]))))).alias("found"))
    k = F.col("l_orderkey")
    wish = lambda c, n, colour=None, relation=None: F.struct(F.lit(c).alias("class"), F.lit(n).alias("count"), F.lit(colour).cast("string").alias("color"), F.lit(relation).cast("string").alias("relation"), F.lit(0 if relation else None).cast("int").alias("target"))
    include = F.when(k % 3 == 0, F.array(wish("cat", 1), wish("dog", 1, None, "left of"))).when(k % 3 == 1, F.array(wish("cat", 2))).otherwise(F.array(wish("dog", 1, "red")))
    exclude = F.when(k % 3 == 1, F.array(wish("cat", 3))).otherwise(F.filter(F.array(wish("cat", 3)), lambda w: F.lit(False)))
    tag = F.when(k % 3 == 0, "position").when(k % 3 == 1, "counting").otherwise("colors")
    return B.evaluated(found.select("l_orderkey", "found", include.alias("include"), exclude.alias("exclude"), tag.alias("tag")), ["l_orderkey"], "found", "include", "exclude", "tag", overlap=0.9)
