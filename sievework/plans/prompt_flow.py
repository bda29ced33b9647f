"""Queries of the prompt flow over the supplied tables: filters, judges, exports, mixtures; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import geometry, hashing, text
from sievework.operators import documents as D
from sievework.operators import filters, judging, mixture
from sievework.plans.catalog import _LINES, _lines, query, read, rounded
from sievework.streaming import queues

# --- filters --------------------------------------------------------------------------------------------

_THINGS, _PLACES = ("table", "chair", "lamp", "window", "mirror"), ("garden", "kitchen", "harbour")
_THOUGHTS = "I look at the wooden window and the mirror, the color 42 first and the light. "
_SQL_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _records(spark, sf_dir):
    """Traces and structured prompts made of orders: some have no trace, no JSON, no keys, bad boxes or another layout."""
    k, part, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("int")
    word = lambda ws, n: F.element_at(F.array(*map(F.lit, ws)), (n + 1).cast("int"))
    caption = F.concat(F.lit("Wooden "), word(_THINGS, part % 5), F.lit(" beside green "), word(_PLACES, part % 3))
    x, y = part % 400, F.col("l_linenumber") * 60
    right = F.when(part % 29 == 0, x).otherwise(x + 40 + q * 5)

    def element(shift):
        box = F.concat(F.lit("<bbox>"), F.concat_ws(" ", *[c.cast("int").cast("string") for c in (x + shift, y, right + shift, y + 50 + q * 4)]), F.lit("</bbox>"))
        return F.struct(caption.alias("caption"), box.alias("position"))

    shift = F.when(k % 4 == 0, 250).otherwise(0)
    each = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", element(F.lit(0)).alias("g"), element(shift).alias("r")))).alias("es"))
    gen, ref = F.transform("es", lambda e: e["g"]), F.transform("es", lambda e: e["r"])
    whole = F.to_json(F.struct(F.when(k % 13 != 0, "a calm picture").alias("intent"), gen.alias("elements")))
    thinking = F.when(k % 17 != 0, F.concat(F.lit("Here is my reasoning:\n"), F.repeat(F.lit(_THOUGHTS), (k % 6 + 1).cast("int")), F.when(k % 7 == 0, "According to the reference, all is well. ").otherwise("")))
    return each.select(
        k.alias("index"), F.when(k % 3 == 1, "backward").otherwise("forward").alias("mode"), F.when(k % 2 == 0, "wooden window mirror").otherwise("strange elephants dancing quietly").alias("prompt"),
        thinking.alias("thinking"), F.when(k % 11 == 0, "no json").otherwise(whole).alias("generated_sp"),
        F.to_json(F.struct(F.lit("a calm picture").alias("intent"), F.when(k % 5 == 0, F.slice(ref, 1, 1)).otherwise(ref).alias("elements"))).alias("reference_sp"))


_FILTER = f"""l AS ({_LINES}),
e AS (SELECT l_orderkey AS k, l_linenumber AS n, {_SQL_LIST(_THINGS)}[l_partkey % 5 + 1] AS thing, {_SQL_LIST(_PLACES)}[l_partkey % 3 + 1] AS place,
  l_partkey % 400 AS x1, l_linenumber * 60 AS y1, CASE WHEN l_partkey % 29 = 0 THEN l_partkey % 400 ELSE l_partkey % 400 + 40 + l_quantity::INT * 5 END AS x2,
  l_linenumber * 60 + 50 + l_quantity::INT * 4 AS y2, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM l),
r AS (SELECT k, n, thing, place, x1 + s AS x1, y1, x2 + s AS x2, y2, nth FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 250 ELSE 0 END AS s FROM e) WHERE k % 5 <> 0 OR nth = 1),
m AS (SELECT e.k, e.n, greatest(0, least(e.x2, r.x2) - greatest(e.x1, r.x1)) * greatest(0, least(e.y2, r.y2) - greatest(e.y1, r.y1)) AS i,
  (e.x2 - e.x1) * (e.y2 - e.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) AS s,
  row_number() OVER (PARTITION BY e.k, e.n ORDER BY (e.thing = r.thing)::INT + (e.place = r.place)::INT DESC, r.nth) AS best FROM e JOIN r ON e.k = r.k),
iou AS (SELECT k, avg(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END) AS iou FROM m WHERE best = 1 GROUP BY k),
a AS (SELECT k, count(*) AS n, bool_and(x2 > x1 AND x2 <= 999 AND y2 <= 999) AS boxes, list_distinct(list(thing) || list(place)) AS own FROM e GROUP BY k),
b AS (SELECT k, count(*) AS n, list_distinct(list(thing) || list(place)) AS want FROM r GROUP BY k),
t AS (SELECT a.k, CASE WHEN a.k % 3 = 1 THEN 'backward' ELSE 'forward' END AS mode, a.k % 17 = 0 AS silent, a.k % 11 <> 0 AND a.k % 13 <> 0 AS json, boxes,
  length('{_THOUGHTS}') * (a.k % 6 + 1) - 1 + CASE WHEN a.k % 7 = 0 THEN 41 ELSE 0 END AS len,
  (len(list_intersect(own, want)) + 5.0) / (len(want) + 5.0) AS share, a.n / b.n AS ratio, iou FROM a JOIN b USING (k) JOIN iou USING (k)),
f AS (SELECT k, mode, silent, mode = 'forward' AND json AND boxes AS whole, iou, CASE WHEN silent THEN ['no_thinking'] ELSE list_filter([
  CASE WHEN NOT len BETWEEN 200 AND 15000 THEN 'length' END, CASE WHEN mode = 'backward' AND k % 7 = 0 THEN 'leakage' END, CASE WHEN k % 2 = 1 THEN 'coherence' END,
  CASE WHEN mode = 'forward' AND NOT json THEN 'invalid_json' END, CASE WHEN mode = 'forward' AND json AND NOT boxes THEN 'invalid_bbox' END,
  CASE WHEN mode = 'forward' AND json AND boxes AND share < 0.25 THEN 'scene_mismatch' END,
  CASE WHEN mode = 'forward' AND json AND boxes AND NOT ratio BETWEEN 0.5 AND 1.5 THEN 'element_count' END], lambda x: x IS NOT NULL) END AS failures FROM t)"""


@query(f"""WITH {_FILTER}
SELECT k AS index, mode, array_to_string(failures, ',') AS failures, len(failures) = 0 AS passed, NOT silent AND whole AND iou < 0.15 AS use_generated FROM f""")
def synth_filter(spark, sf_dir):
    got = filters.filtered(_records(spark, sf_dir))
    return got.select("index", "mode", F.array_join("failures", ",").alias("failures"), "passed", "use_generated")


@query(f"WITH {_FILTER} SELECT failure, count(*) AS n FROM (SELECT unnest(CASE WHEN len(failures) = 0 THEN ['passed'] ELSE failures END) AS failure FROM f) GROUP BY 1")
def failure_counts(spark, sf_dir):
    return filters.failure_counts(filters.filtered(_records(spark, sf_dir)))


@query("""
SELECT doc_id, CASE WHEN n = 0 THEN ' ' ELSE c[least(floor(u * n)::BIGINT, n - 1) + 1] END AS caption
FROM (SELECT doc_id, source, c, len(c) AS n, ('0x' || left(sha256('caption|' || doc_id::VARCHAR), 13))::BIGINT / 4503599627370496.0 AS u
      FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN [lang] ELSE [source, lang] END AS c FROM documents))
WHERE source <> (SELECT min(source) FROM documents)""")
def caption_choice(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    denied = d.agg(F.min("source")).collect()[0][0]
    captions = F.create_map(
        F.lit("text_en_long"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.lit("text_cn_short"), F.when(F.col("doc_id") % 3 == 2, F.col("source")),
        F.lit("en_note"), F.lit("never"), F.lit("text_en_empty"), F.lit(""))
    key = F.concat(F.lit("caption|"), F.col("doc_id").cast("string"))
    return d.where(filters.allowed_category(F.col("source"), [denied])).select("doc_id", filters.chosen_caption(filters.caption_candidates(captions), key).alias("caption"))


@query("SELECT l_orderkey, CASE WHEN n >= 5 THEN text END AS text FROM (SELECT l_orderkey, count(*) AS n, list('part ' || l_partkey ORDER BY l_linenumber DESC)[5] AS text FROM (" + _LINES + ") GROUP BY 1)")
def embedded_caption(spark, sf_dir):
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("part "), F.col("l_partkey")).alias("text")))).alias("xs"))
    return rows.select("l_orderkey", filters.embedded_caption(F.to_json(F.transform("xs", lambda x: F.struct(x["text"].alias("text"))))).alias("text"))


@query("""
SELECT o_orderkey, [CASE WHEN i >= (o_orderkey % 4) THEN 'UNSUPPORTED' WHEN (o_orderkey + i) % 3 = 0 THEN 'SUPPORTED' WHEN (o_orderkey + i) % 3 = 1 THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END FOR i IN range(0, o_orderkey % 5)]::VARCHAR AS verdicts
FROM orders""")
def claim_verdicts(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when((k + i) % 3 == 0, " supported").when((k + i) % 3 == 1, "Contradicted\n").otherwise("who knows"))
    v = filters.normal_verdicts(F.slice(said, F.lit(1), (k % 4).cast("int")), (k % 5).cast("int"), ("SUPPORTED", "CONTRADICTED", "UNSUPPORTED"), "UNSUPPORTED")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(v, ", "), F.lit("]")).alias("verdicts"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 1 AND o_orderkey % 5 <> 2")
def exam_answers_valid(spark, sf_dir):
    k = F.col("o_orderkey")
    answers = F.array(F.lit(1), F.lit(0), F.when(k % 4 == 0, 2).otherwise(1))
    points = F.when(k % 3 == 1, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)))
    facets = F.create_map(F.lit("Spelling"), F.lit(2), F.lit("Clarity and Readability"), F.lit(1), F.when(k % 5 == 2, "Logic").otherwise("Logical Consistency"), F.lit(0))
    return read(spark, sf_dir, "orders").where(filters.exam_answer_valid(answers, points, facets)).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_id % 7 <> 0 AND event_id % 7 <> 3 AND event_type <> (SELECT min(event_type) FROM events)")
def answered_rows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 7 == 0, "__ERROR__ timeout").when(F.col("event_id") % 7 == 3, "").otherwise("fine")
    files = e.select("event_type").distinct().where(F.col("event_type") != e.agg(F.min("event_type")).collect()[0][0])
    return filters.present(e.where(~filters.is_error(answer)).withColumn("success", F.lit(None).cast("boolean")), files, "event_type").select("event_id")


@query("""
SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, event_type FROM events WHERE event_type <> (SELECT max(event_type) FROM events))
WHERE i % 7 = 3 ORDER BY i LIMIT 40""")
def shard_rows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())[:-1]  # a handful of kinds
    return filters.shard_of(e, ["ts", "event_id"], 7, 3, kinds, "event_type", 40).select("event_id")


# --- text -----------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[aeiou]') THEN 'an ' ELSE 'a ' END || p_name AS one, p_name || CASE WHEN p_name LIKE '%s' THEN 'es' ELSE 's' END AS many,
       left(sha1('SYSTEM' || chr(10) || p_type || chr(10) || 'USER' || chr(10) || p_name), 12) AS version, p_type AS system, p_name AS user
FROM part""")
def prompt_words(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    s = text.prompt_sections(F.concat(F.lit("SYSTEM\n"), "p_type", F.lit("\nUSER\n"), "p_name"))
    return p.select("p_partkey", text.with_article(F.col("p_name")).alias("one"), text.plural(F.col("p_name")).alias("many"), s.alias("s")).select("p_partkey", "one", "many", "s.version", "s.system", "s.user")


@query("SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' more' ELSE '' END AS caption FROM part")
def plain_captions(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    said = F.concat(F.when(k % 5 == 0, "Create an image showing ").when(k % 5 == 1, "Please draw ").otherwise(""), "p_name", F.when(k % 5 == 1, " for me").otherwise(""), F.when(k % 2 == 0, ".").otherwise(""), F.when(k % 3 == 0, " more").otherwise(""))
    return p.select("p_partkey", text.without_templates(said, ["Create an image showing {}", "Please draw {} for me"]).alias("caption"))


@query("""
WITH p AS (SELECT a.conv_id, string_agg(a.text, chr(10) ORDER BY a.turn) AS x FROM conversations a GROUP BY 1),
q AS (SELECT p.conv_id, string_split(p.x, chr(10)) AS a, string_split(r.x, chr(10)) AS b FROM p JOIN p r ON p.conv_id + 1 = r.conv_id),
d AS (SELECT conv_id, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM q)
SELECT conv_id, count(*) AS n, min(i)::INT AS first FROM d WHERE a[i] IS DISTINCT FROM b[i] GROUP BY 1""")
def line_diffs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("ts")).select("conv_id", F.array_join(F.transform("ts", lambda t: t["text"]), "\n").alias("x"))
    pairs = c.join(c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("x").alias("y")), "conv_id")
    d = pairs.select("conv_id", F.explode(text.line_diff(F.col("x"), F.col("y"))).alias("d"))
    return d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("d.line").alias("first"))


@query("SELECT page_id, 'data:image/' || CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'jpeg' END || ';base64,' || to_base64((CASE WHEN page_id % 2 = 0 THEN unhex('89504E470D0A1A0A') ELSE unhex('FFD8FF') END || encode(url))::BLOB) AS url FROM pages")
def data_urls(spark, sf_dir):
    head = F.when(F.col("page_id") % 2 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("FFD8FF")))
    return read(spark, sf_dir, "pages").select("page_id", text.data_url(F.concat(head, F.encode("url", "utf-8"))).alias("url"))


@query()
def degraded_prompts(spark, sf_dir):
    """Every record's reference prompt at three levels, by hashed chance from its number."""
    r = _records(spark, sf_dir).select("index", F.concat_ws("\x1f", F.col("index").cast("string"), "reference_sp").alias("x"))
    level = lambda n: D.mapped(F.col("x"), lambda t: D.degraded(t.partition("\x1f")[2], t.partition("\x1f")[0], D.level(n)))
    return r.select("index", *[level(n).alias(n.replace(".", "_")) for n in ("l9", "l8_dropBGFG", "l4")])


# --- judges ---------------------------------------------------------------------------------------------

_SAMPLES = f"""s AS (SELECT l_orderkey AS index, l_linenumber AS image_idx, (l_partkey % 4 <> 0) AS valid, CASE WHEN l_partkey % 7 > 0 THEN round(l_quantity / 50, 4) END AS score, l_partkey FROM ({_LINES})),
v AS (SELECT *, sum(valid::INT) OVER (PARTITION BY index) AS n_valid FROM s),
g AS (SELECT *, CASE WHEN n_valid = 0 THEN 0.0 WHEN valid THEN coalesce(score, 0.0) ELSE '-inf'::DOUBLE END AS rating FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY index ORDER BY rating DESC, valid DESC, image_idx) AS place FROM g)"""


def _samples(spark, sf_dir):
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("index"), F.col("l_linenumber").alias("image_idx"), (F.col("l_partkey") % 4 != 0).alias("valid"),
        F.when(F.col("l_partkey") % 7 > 0, F.round(F.col("l_quantity") / 50, 4)).alias("score"), "l_partkey")


def _single(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return judging.rankings(judging.ranked_samples("single", s.drop("score"), s.select("index", "image_idx", "score")))


@query(f"""WITH {_SAMPLES}
SELECT index, count(*)::INT AS n_samples, max(n_valid)::BIGINT AS n_valid, string_agg(image_idx::VARCHAR, ',' ORDER BY place) AS rankings, min(image_idx) FILTER (WHERE place = 1) AS best_image_idx FROM o GROUP BY index""")
def single_rankings(spark, sf_dir):
    return _single(spark, sf_dir).select("index", "n_samples", "n_valid", F.array_join("rankings", ",").alias("rankings"), "best_image_idx")


_VERIFIED = f"""{_SAMPLES},
best AS (SELECT index, image_idx AS best, l_partkey FROM o WHERE place = 1),
d AS (SELECT index, best, f.i, f.name, CASE WHEN (l_partkey + f.i) % 5 > 0 THEN ((l_partkey + f.i) % 10) / 10.0 END AS score, (l_partkey + f.i) % 3 > 0 AS pass
      FROM best, (VALUES (0, 'aesthetic'), (1, 'alignment'), (2, 'structure'), (3, 'thinking')) f(i, name) WHERE l_partkey % 9 > 0 AND (f.i < 3 OR index % 2 = 0)),
w AS (SELECT b.index, b.best, b.l_partkey, avg(score) AS m, coalesce(bool_and(pass) FILTER (WHERE score IS NOT NULL), true) AS ok,
      avg(score) FILTER (WHERE name IN ('alignment', 'structure')) AS clean, max(score) FILTER (WHERE name = 'structure') AS structure,
      coalesce(bool_and(pass) FILTER (WHERE name IN ('alignment', 'structure')), false) AS facets FROM best b LEFT JOIN d ON d.index = b.index GROUP BY ALL)"""


def _verified(spark, sf_dir):
    s = _samples(spark, sf_dir)
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("facet")) for i, n in enumerate(("aesthetic", "alignment", "structure", "thinking"))])
    asked = s.where("l_partkey % 9 > 0").select("index", "image_idx", "l_partkey", F.inline(names))
    x = F.col("l_partkey") + F.col("i")
    verdicts = asked.select("index", "image_idx", "facet", F.when(x % 5 > 0, (x % 10) / 10.0).alias("score"), (x % 3 > 0).alias("pass"))
    return judging.two_phase(_single(spark, sf_dir), verdicts, s.where("index % 2 = 0"))


@query(f"WITH {_VERIFIED} SELECT index, best AS best_image_idx, round_even(m, 4) AS overall_score, ok AS overall_pass FROM w")
def two_phase(spark, sf_dir):
    return _verified(spark, sf_dir).select("index", "best_image_idx", "overall_score", "overall_pass")


_EXPORT = f"""{_VERIFIED},
r AS (SELECT index, l_partkey, best, clean, facets, ok, structure, best % 5 > 0 AS found, index % 8 > 0 AS said, 'so wait and wait ' || repeat('x', (index % 40)::INT) AS thinking FROM w),
x AS (SELECT index, clean, CASE WHEN NOT ok THEN 'overall_pass' WHEN NOT facets THEN 'facets' WHEN clean IS NULL OR clean < 0.3 OR structure IS NULL OR structure < 0.2 THEN 'score' WHEN NOT found THEN 'no_rollout' WHEN NOT said THEN 'no_messages'
  WHEN length(thinking) + CASE WHEN index % 3 = 0 THEN 5 ELSE 0 END > 50 THEN 'length' WHEN index % 3 = 0 THEN 'waits' ELSE 'written' END AS state FROM r)"""


@query(f"WITH {_EXPORT} SELECT state, count(*) AS n, round(avg(clean), 6) AS clean FROM x GROUP BY state")
def export_gates(spark, sf_dir):
    thinking = F.concat(F.lit("so wait and wait "), F.repeat(F.lit("x"), (F.col("index") % 40).cast("int")))
    thought = F.concat(F.lit("<think>"), thinking, F.lit("</think> {}"))
    messages = F.when(F.col("index") % 8 > 0, judging.chat_messages(F.lit("be kind"), F.lit("draw"), F.lit(""), thought))
    # the third round has one more wait than is allowed
    rollouts = _samples(spark, sf_dir).where("image_idx % 5 > 0").select("index", "image_idx", messages.alias("messages"), F.when(F.col("index") % 3 == 0, F.concat(F.lit("<think>"), thinking, F.lit(" WAIT</think>"))).alias("raw"))
    states = judging.export_states(_verified(spark, sf_dir), rollouts, least_score=0.3, floors={"structure": 0.2}, require_pass=True, require_facets=True, most_waits=2, most_length=50)
    return rounded(states.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg("clean_score").alias("clean")))


@query("""
WITH s AS (SELECT 'w' || p_partkey % 5 || '_t_' || p_partkey // 2 || '.json' AS done, 't_' || p_partkey // 2 || '.json' AS task, p_partkey AS k FROM part)
SELECT DISTINCT task FROM s WHERE k % 10 <> 9 AND task NOT IN (SELECT task FROM s WHERE k % 7 = 0)""")
def backfill(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 2).cast("string").alias("t"))
    own, held = F.concat(F.lit("t_"), "t", F.lit(".json")), F.concat(F.lit("w"), (F.col("k") % 5).cast("string"), F.lit("_t_"), "t", F.lit(".json"))
    state = F.when(F.col("k") % 3 == 0, "pending").when(F.col("k") % 3 == 1, "done").otherwise("claimed")
    file = lambda s: F.when(s == "pending", own).otherwise(held)
    source = p.select(F.when(F.col("k") % 10 == 9, "w_note.txt").otherwise(file(state)).alias("file"), state.alias("state"))
    target = p.where("k % 7 = 0").select(file(F.lit("done")).alias("file"), F.lit("done").alias("state"))
    return judging.backfilled(source, target).select("task")


@query("""
WITH n AS (SELECT max(ts) AS now FROM events), t AS (SELECT event_type AS queue, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' ELSE 'done' END AS state, ts FROM events)
SELECT queue, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'claimed') AS claimed, count(*) FILTER (WHERE state = 'done') AS done,
       round(count(*) FILTER (WHERE state = 'done') / count(*), 6) AS share_done, count(*) FILTER (WHERE state = 'done' AND epoch(now) - epoch(ts) < 86400) AS lately,
       round(count(*) FILTER (WHERE state <> 'done') * 86400.0 / nullif(count(*) FILTER (WHERE state = 'done' AND epoch(now) - epoch(ts) < 86400), 0), 6) AS seconds_left
FROM t, n GROUP BY queue""")
def queue_progress(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    t = e.crossJoin(F.broadcast(now)).select(F.col("event_type").alias("queue"), F.when(F.col("event_id") % 4 == 0, "pending").when(F.col("event_id") % 4 == 1, "claimed").otherwise("done").alias("state"), "ts", "now")
    return rounded(queues.progress(t, "queue", "state", "ts", F.col("now"), 86400.0))


@query("""
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT CASE WHEN event_id % 3 = 0 AND epoch(now) - epoch(ts) < 172800 THEN 'claimed' WHEN event_id % 3 = 1 THEN 'done' ELSE 'pending' END AS state, count(*) AS n FROM events, n GROUP BY 1""")
def reparked_claims(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    t = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).withColumn("state", F.when(F.col("event_id") % 3 == 0, "claimed").when(F.col("event_id") % 3 == 1, "done").otherwise("pending"))
    return queues.depth(queues.reparked(t, "state", "ts", F.col("now"), 172800), "state")


# --- mixtures and batches -------------------------------------------------------------------------------

_U = lambda key: f"('0x' || left(sha256({key}), 13))::BIGINT / 4503599627370496.0"


@query(f"""
WITH w(g, lo, hi) AS (VALUES ('R', 0.0, 0.5), ('A', 0.5, 0.8), ('N', 0.8, 1.0)),
own AS (SELECT l_returnflag AS g, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS nth
        FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_linenumber FROM lineitem)),
u AS (SELECT k, {_U("'mix|' || k::VARCHAR")} AS u FROM range(0, 2 * (SELECT count(*) FROM lineitem)) t(k)),
d AS (SELECT k, g, row_number() OVER (PARTITION BY g ORDER BY k) AS nth FROM u JOIN w ON u >= lo AND u < hi),
e AS (SELECT min(k) AS stop FROM d LEFT JOIN own USING (g, nth) WHERE own.g IS NULL)
SELECT k AS place, l_orderkey, l_linenumber, g AS l_returnflag FROM d JOIN own USING (g, nth), e WHERE k < stop""")
def dataset_mixture(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber").distinct()
    return mixture.mixed(rows, "l_returnflag", ["l_orderkey", "l_linenumber"], {"R": 0.5, "A": 0.3, "N": 0.2}).select("place", "l_orderkey", "l_linenumber", "l_returnflag")


@query(f"""
SELECT doc_id, {_U("doc_id || '|text'")} < 0.1 AS text, {_U("doc_id || '|vit'")} < 0.4 AS vit, {_U("doc_id || '|vae'")} < 0.1 AS vae,
       round(CASE WHEN {_U("doc_id || '|a'")} < 0.7 THEN {_U("doc_id || '|b'")} * 0.3 ELSE 0.3 + {_U("doc_id || '|b'")} * 0.7 END, 9) AS level FROM documents""")
def condition_dropout(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    u = lambda n: hashing.uniform(F.concat_ws("|", key, F.lit(n)))
    d = mixture.dropped_conditions(key, mixture.DROPOUT)
    return read(spark, sf_dir, "documents").select("doc_id", d.alias("d"), F.round(mixture.two_piece_uniform(u("a"), u("b"), 0.3), 9).alias("level")).select("doc_id", "d.*", "level")


@query(f"""
WITH p AS (SELECT p_partkey, p_size AS s, least(floor({_U("p_partkey || '|parts'")} * p_size)::INT + 1, p_size) AS n FROM part),
c AS (SELECT p_partkey, s, n, list_sort(list_slice([x.i FOR x IN list_sort([{{'u': {_U("p_partkey || '|cut|' || i::VARCHAR")}, 'i': i}} FOR i IN range(1, s)])], 1, n - 1)) AS cuts FROM p),
e AS (SELECT p_partkey, [0] || cuts || [s] AS e FROM c)
SELECT p_partkey, list_transform(range(1, len(e)), lambda i: (e[i + 1] - e[i])::INT)::VARCHAR AS parts FROM e""")
def frame_composition(spark, sf_dir):
    parts = mixture.composed(F.col("p_size"), F.col("p_partkey").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")).alias("parts"))


@query("""
SELECT doc_id, bucket, (row_number() OVER (PARTITION BY bucket ORDER BY n_chars, doc_id) - 1) // 16 AS batch FROM (SELECT *, CASE WHEN n_chars <= 500 THEN 0 WHEN n_chars <= 2000 THEN 1 ELSE 2 END AS bucket FROM documents)""")
def length_batches(spark, sf_dir):
    return mixture.length_batches(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", ["n_chars", "doc_id"], 16, (500, 2000, 1 << 30)).select("doc_id", "bucket", "batch")


@query("""
SELECT batch, count(*)::INT AS n, string_agg(p_name, chr(10) || '<<<SEP>>>' || chr(10) ORDER BY p_partkey) AS prompts FROM (SELECT *, (row_number() OVER (ORDER BY p_partkey) - 1) // 8 AS batch FROM part) GROUP BY batch""")
def joined_batches(spark, sf_dir):
    return mixture.joined_batches(read(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"], "p_name", 8)


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, sum(l_quantity)::BIGINT AS n, max(l_partkey % 7 + 1)::INT AS h, max(l_suppkey % 5 + 1)::INT AS w FROM lineitem GROUP BY ALL),
t AS (SELECT l_orderkey, max(l_linenumber) + 1 AS l_linenumber, 200 - sum(n) AS n FROM s GROUP BY 1 HAVING sum(n) < 200)
SELECT l_orderkey, l_linenumber, n::BIGINT AS n, attention, h, w FROM (
  SELECT l_orderkey, l_linenumber, n, 'full' AS attention, max(h) OVER (PARTITION BY l_orderkey) AS h, max(w) OVER (PARTITION BY l_orderkey) AS w FROM s
  UNION ALL SELECT l_orderkey, l_linenumber, n, 'causal', NULL, NULL FROM t)""")
def padded_packs(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").cast("long").alias("n"), F.max(F.col("l_partkey") % 7 + 1).cast("int").alias("h"), F.max(F.col("l_suppkey") % 5 + 1).cast("int").alias("w"))
    sizes = mixture.padded(s, "l_orderkey", ["h", "w"]).select("l_orderkey", "l_linenumber", F.col("padded_h").alias("h"), F.col("padded_w").alias("w"))
    splits = mixture.padded_tail(s.withColumn("attention", F.lit("full")), "l_orderkey", "l_linenumber", "n", 200)
    return splits.join(sizes, ["l_orderkey", "l_linenumber"], "left")


@query("SELECT p_partkey, p_size + 39 AS encoder, p_size + 5 AS sequence, 34 AS begin FROM part")
def template_lengths(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", mixture.template_lengths(F.col("p_size")).alias("t")).select("p_partkey", "t.*")


@query()
def mandatory_packs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 500).alias("shard"), "doc_id", (F.floor(F.col("n_chars") / 4) + 4).cast("int").alias("cost"), "lang")
    return mixture.with_mandatory(d, "shard", "doc_id", "cost", "lang", ["en"])


@query("SELECT p_name AS class, 'a photo of ' || CASE WHEN regexp_matches(p_name, '^[aeiou]') THEN 'an ' ELSE 'a ' END || p_name AS prompt FROM part GROUP BY 1")
def single_object_prompts(spark, sf_dir):
    s = mixture.prompt_suite(read(spark, sf_dir, "part"), "p_name", 20)
    return s.where("tag = 'single_object'").select(F.col("include")[0]["class"].alias("class"), "prompt")


@query()
def prompt_suite(spark, sf_dir):
    return mixture.prompt_suite(read(spark, sf_dir, "part"), "p_name", 50)


@query("""
SELECT c_custkey, c_name AS prompt, CASE WHEN c_custkey % 2 = 0 THEN 'b' || c_custkey % 3 || '.jpg' END AS chosen, CASE WHEN c_custkey > 0 THEN gcd(c_custkey, 1024)::INT END AS g,
       CASE WHEN c_custkey > 0 THEN (c_custkey // gcd(c_custkey, 1024)) || ':' || (1024 // gcd(c_custkey, 1024)) END AS ratio FROM customer""")
def simple_ratios(spark, sf_dir):
    r = geometry.simple_ratio(F.col("c_custkey"), F.lit(1024).cast("long"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("prompt"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("b"), (F.col("c_custkey") % 3).cast("string"), F.lit(".jpg"))).alias("chosen"), r["g"].cast("int").alias("g"), r["ratio"].alias("ratio"))
