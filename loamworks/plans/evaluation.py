"""Evaluation metrics and statistics with resampling, over inputs derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..operators import resampling
from ..operators.actions import DECAY, NEAR, SIMILAR, in_boxes, stream_score
from ..operators.retrieval import cosine_topk
from ..operators.scoring import gate_table, name_overlap, pass_hat, ratio, same_calls, sign_test
from ..registry import Register
from ..sources.stages import table
from .standins import ACTIONS, CALLS, LATENCY, SCORED, TRIALS, actions, attempts, calls, cases, scored, trials

QUERIES = query = Register()
#: A score within this of 1 is a success.
CLOSE = 1e-6
CASES = f"""{CALLS}, cs AS (SELECT case_id, coalesce(list([name, args::VARCHAR] ORDER BY pos) FILTER (WHERE side = 'gold'), []) AS gold, coalesce(list([name, args::VARCHAR] ORDER BY pos) FILTER (WHERE side = 'pred'), []) AS pred FROM calls GROUP BY case_id)"""
EXACT = "list_sort(gold) = list_sort(pred)"


@query(f"WITH {CASES} SELECT case_id, {EXACT} AS exact FROM cs")
def ev_call_match(spark, sf_dir):
    return cases(spark, sf_dir).select("case_id", same_calls(F.col("gold"), F.col("pred")).alias("exact"))


@query(f"""WITH {CALLS}, n AS (SELECT case_id, name, count(*) FILTER (WHERE side = 'gold') AS g, count(*) FILTER (WHERE side = 'pred') AS p FROM calls GROUP BY ALL), s AS (SELECT sum(least(g, p)) AS c, sum(g) AS g, sum(p) AS p FROM n)
SELECT round(c / nullif(p, 0), 6) AS precision, round(c / nullif(g, 0), 6) AS recall, round(2 * c / nullif(g + p, 0), 6) AS f1 FROM s""")
def ev_name_prf(spark, sf_dir):
    """Micro precision, recall and F1 on the multisets of call names."""
    s = name_overlap(calls(spark, sf_dir), ["case_id"]).agg(F.sum("common").alias("c"), F.sum("n_gold").alias("g"), F.sum("n_pred").alias("p"))
    c, g, p = map(F.col, "cgp")
    return s.select(ratio(c, p).alias("precision"), ratio(c, g).alias("recall"), ratio(2 * c, g + p).alias("f1"))


@query(f"""WITH {CASES}, k AS (SELECT *, ({EXACT})::INT AS exact, (gold = pred)::INT AS response, len([p for p in pred if p[1] = 'XX']) = 0 AS formed, len([p for p in pred if p[2]::INT > 50]) = 0 AS fits,
  (list_sort([g[1] for g in gold]) = list_sort([p[1] for p in pred]))::INT AS names FROM cs)
SELECT count(*) AS cases, round(avg(exact), 6) AS action_exact, round(avg(response), 6) AS response_exact, round(avg((len(pred) > 0)::INT), 6) AS produced, round(avg(formed::INT), 6) AS format_valid, round(avg((formed AND fits)::INT) FILTER (WHERE len(pred) > 0), 6) AS schema_valid,
  round(avg(names), 6) AS name_exact, round(avg(exact) FILTER (WHERE len(gold) > 1), 6) AS parallel_exact, round(avg(exact) FILTER (WHERE len([g for g in gold if g[2]::INT >= 10]) > 0), 6) AS multi_argument_exact,
  round(avg((len(pred) = 0)::INT) FILTER (WHERE len(gold) = 1), 6) AS abstained_on_single, round(avg((gold[1] = pred[1])::INT) FILTER (WHERE gold[1][1] = pred[1][1]), 6) AS args_given_name FROM k""")
def ev_scorecard(spark, sf_dir):
    """One aggregate of conditional means. A response is exact in order too; `XX` is no known name, arguments above 50 break the schema, and two digits are two arguments."""
    names = lambda c: F.array_sort(F.transform(c, lambda x: x["name"]))
    c = cases(spark, sf_dir).withColumn("exact", same_calls(F.col("gold"), F.col("pred")).cast("int"))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["name"], x["args"]))
    c = c.withColumns({"response": (plain("gold") == plain("pred")).cast("int"), "formed": ~F.exists("pred", lambda x: x["name"] == "XX"), "fits": ~F.exists("pred", lambda x: x["args"] > 50), "names": (names("gold") == names("pred")).cast("int")})
    g, p = F.try_element_at("gold", F.lit(1)), F.try_element_at("pred", F.lit(1))
    mean = lambda x, cond=F.lit(True): F.round(F.avg(F.when(cond, x)), 6)
    exact = F.col("exact")
    return c.agg(
        F.count("*").alias("cases"), mean(exact).alias("action_exact"), mean(F.col("response")).alias("response_exact"), mean((F.size("pred") > 0).cast("int")).alias("produced"), mean(F.col("formed").cast("int")).alias("format_valid"),
        mean((F.col("formed") & F.col("fits")).cast("int"), F.size("pred") > 0).alias("schema_valid"), mean(F.col("names")).alias("name_exact"), mean(exact, F.size("gold") > 1).alias("parallel_exact"),
        mean(exact, F.exists("gold", lambda x: x["args"] >= 10)).alias("multi_argument_exact"), mean((F.size("pred") == 0).cast("int"), F.size("gold") == 1).alias("abstained_on_single"), mean((g["args"] == p["args"]).cast("int"), g["name"] == p["name"]).alias("args_given_name"),
    )


@query(f"WITH {TRIALS}, e AS (SELECT task_id, bool_and(NOT infra) AS exact, count(*) AS steps FROM trials GROUP BY task_id) SELECT count(*) AS episodes, count(*) FILTER (WHERE exact) AS exact_episodes, round(avg(exact::INT), 6) AS rate FROM e")
def ev_episode_exact(spark, sf_dir):
    e = trials(spark, sf_dir).groupBy("task_id").agg(F.bool_and(~F.col("infra")).alias("exact"))
    return e.agg(F.count("*").alias("episodes"), F.count_if("exact").alias("exact_episodes"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("rate"))


@query(f"""WITH {CASES}, x AS (SELECT len(gold) AS n, gold, pred, [gold[i] = pred[i] for i in generate_series(1, greatest(len(gold), len(pred)))] AS hit FROM cs)
SELECT n AS gold_len, count(*) AS plans, round(avg((gold = pred)::INT), 6) AS whole, round(avg((len(gold) = len(pred))::INT), 6) AS same_length, round(avg(len([h for h in hit if h]) / len(hit)), 6) AS step_accuracy FROM x GROUP BY n""")
def ev_plan(spark, sf_dir):
    """Whole plans, lengths and positional steps over the longer plan, by gold length."""
    plain = lambda c: F.transform(c, lambda x: F.struct(x["name"], x["args"]))
    c = cases(spark, sf_dir).select(plain("gold").alias("g"), plain("pred").alias("p"))
    hits = F.aggregate(F.zip_with("g", "p", lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(0), lambda s, x: s + x.cast("int"))
    c = c.withColumn("step", hits / F.greatest(F.size("g"), F.size("p")))
    return c.groupBy(F.size("g").cast("long").alias("gold_len")).agg(F.count("*").alias("plans"), F.round(F.avg((F.col("g") == F.col("p")).cast("int")), 6).alias("whole"), F.round(F.avg((F.size("g") == F.size("p")).cast("int")), 6).alias("same_length"), F.round(F.avg("step"), 6).alias("step_accuracy"))


@query(f"WITH {CASES} SELECT o_orderpriority AS category, count(*) AS cases, count(*) FILTER (WHERE {EXACT}) AS correct, round(avg(({EXACT})::INT), 6) AS accuracy FROM cs JOIN orders ON o_orderkey = case_id GROUP BY 1")
def ev_by_category(spark, sf_dir):
    c = cases(spark, sf_dir).select("case_id", same_calls(F.col("gold"), F.col("pred")).alias("exact"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("category"))
    return c.join(o, "case_id").groupBy("category").agg(F.count("*").alias("cases"), F.count_if("exact").alias("correct"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("accuracy"))


FIRST = "gold[1][1] = pred[1][1]"


@query(f"WITH {CASES} SELECT count(*) AS selected, round(avg((gold[1][2] = pred[1][2])::INT), 6) AS argument_accuracy FROM cs WHERE {FIRST}")
def ev_args_given_sel(spark, sf_dir):
    g, p = F.try_element_at("gold", F.lit(1)), F.try_element_at("pred", F.lit(1))
    return cases(spark, sf_dir).filter(g["name"] == p["name"]).agg(F.count("*").alias("selected"), F.round(F.avg((g["args"] == p["args"]).cast("int")), 6).alias("argument_accuracy"))


@query(f"WITH {CASES} SELECT len(gold) AS arity, count(*) AS cases, round(avg(({EXACT})::INT), 6) AS full_call, round(avg(coalesce({FIRST}, false)::INT), 6) AS tool_at_1 FROM cs GROUP BY 1")
def ev_arity(spark, sf_dir):
    g, p = F.try_element_at("gold", F.lit(1)), F.try_element_at("pred", F.lit(1))
    hit = F.coalesce(g["name"] == p["name"], F.lit(False)).cast("int")
    return cases(spark, sf_dir).groupBy(F.size("gold").cast("long").alias("arity")).agg(F.count("*").alias("cases"), F.round(F.avg(same_calls(F.col("gold"), F.col("pred")).cast("int")), 6).alias("full_call"), F.round(F.avg(hit), 6).alias("tool_at_1"))


@query(f"WITH {TRIALS} SELECT coalesce(service, '*') AS service, coalesce(parity, -1) AS parity, count(*) AS n, round(avg(success::INT), 6) AS accuracy FROM (SELECT service, event_id % 2 AS parity, success FROM trials) GROUP BY GROUPING SETS ((service), (parity), ())")
def ev_route(spark, sf_dir):
    """Accuracy per route, per difficulty and overall: grouping sets in one pass."""
    t = trials(spark, sf_dir).select("service", (F.col("event_id") % 2).alias("parity"), "success")
    g = t.groupingSets([[F.col("service")], [F.col("parity")], []], "service", "parity").agg(F.count("*").alias("n"), F.round(F.avg(F.col("success").cast("int")), 6).alias("accuracy"))
    return g.select(F.coalesce("service", F.lit("*")).alias("service"), F.coalesce("parity", F.lit(-1)).alias("parity"), "n", "accuracy")


@query(f"WITH {LATENCY} SELECT family, round(avg(valid::INT), 6) AS parse_rate, round(avg((valid AND exact)::INT), 6) AS step_success, count(*) FILTER (WHERE ms > 50) AS eligible, round(avg(exact::INT) FILTER (WHERE ms > 50), 6) AS grounding FROM attempts GROUP BY family")
def ev_step_metrics(spark, sf_dir):
    e = F.col("ms") > 50
    return attempts(spark, sf_dir).groupBy("family").agg(F.round(F.avg(F.col("valid").cast("int")), 6).alias("parse_rate"), F.round(F.avg((F.col("valid") & F.col("exact")).cast("int")), 6).alias("step_success"), F.count_if(e).alias("eligible"), F.round(F.avg(F.when(e, F.col("exact").cast("int"))), 6).alias("grounding"))


POINTS = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS x, l_discount * 10 AS y, l_quantity / 50 + (l_suppkey % 5) / 20.0 AS px, l_discount * 10 + (l_partkey % 3) / 25.0 AS py FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, sqrt((x - px) ** 2 + (y - py) ** 2) <= 0.14 * (CASE WHEN greatest(x, y) <= 1 THEN 1 ELSE 100 END) AS within FROM ({POINTS})")
def ev_point_within(spark, sf_dir):
    """Clicks within 14 % of the screen's extent; normalised and pixel coordinates told apart per row."""
    x, y = F.col("l_quantity") / 50, F.col("l_discount") * 10
    extent = F.when(F.greatest(x, y) <= 1, 1).otherwise(100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.hypot(F.col("l_suppkey") % 5 / 20.0, F.col("l_partkey") % 3 / 25.0) <= 0.14 * extent).alias("within"))


@query(f"""WITH {ACTIONS}, g AS (SELECT *, CASE WHEN type = 'hotkey' AND key <> 'Enter' THEN 'ctrl ' || key ELSE key END AS keys FROM acts),
j AS (SELECT g.case_id, p.type IS NOT NULL AS met, coalesce(g.type = p.type, false) AS tool, g.type IN ('click', 'doubleClick') AS point, g.boxed, g.x AS gx, g.y AS gy, p.x AS px, p.y AS py,
  CASE WHEN g.type IN ('click', 'doubleClick') THEN g.x = p.x AND g.y = p.y WHEN g.type = 'write' THEN g.text = p.text WHEN g.type IN ('press', 'hotkey') THEN g.keys = p.keys WHEN g.type = 'scroll' THEN g.amount IS NOT DISTINCT FROM p.amount AND g.way IS NOT DISTINCT FROM p.way
    WHEN g.type = 'wait' THEN g.seconds = p.seconds ELSE g.status = p.status END AS same FROM g LEFT JOIN g p ON p.case_id = g.case_id AND p.pos = g.pos AND p.side = 'pred' WHERE g.side = 'gold'),
n AS (SELECT case_id, count(*) FILTER (WHERE side = 'gold') AS ng, count(*) FILTER (WHERE side = 'pred') AS np FROM acts GROUP BY case_id),
c AS (SELECT case_id, count(*) FILTER (WHERE tool AND same) AS e FROM j GROUP BY case_id)
SELECT count(*) AS expected, (SELECT sum(np) FROM n)::BIGINT AS predicted, count(*) FILTER (WHERE met) AS compared, round(avg(tool::INT), 6) AS tool_accuracy, round(avg((tool AND coalesce(same, false))::INT), 6) AS exact_accuracy,
  round(avg(greatest(0, 1 - sqrt((px - gx) ** 2 + (py - gy) ** 2) / greatest(abs(gx), abs(gy), 1))) FILTER (WHERE tool AND point), 6) AS coordinate_score,
  round(avg((px BETWEEN gx - 0.005 AND gx - 0.005 + 0.05 AND py BETWEEN gy - 0.005 AND gy - 0.005 + 0.05)::INT) FILTER (WHERE tool AND point AND boxed), 6) AS box_hits,
  (SELECT count(*) FROM n JOIN c USING (case_id) WHERE ng = np AND e = ng) AS exact_trajectories FROM j""")
def ev_mobile_stream(spark, sf_dir):
    """Two streams of screen actions aligned by position; the denominator is the expected length. Coordinates count for actions of one type, boxes where the expected action has one."""
    s = actions(spark, sf_dir).filter(F.size("gold") > 0)
    j = s.select("case_id", F.size("gold").alias("ng"), F.size("pred").alias("np"), F.posexplode("gold").alias("pos", "g"), "pred").withColumn("p", F.get("pred", F.col("pos")))
    g, p = F.col("g"), F.col("p")
    point = g["type"].isin("click", "doubleClick")
    same = F.when(point, (g["x"] == p["x"]) & (g["y"] == p["y"])).when(g["type"] == "write", g["text"] == p["text"]).when(g["type"].isin("press", "hotkey"), g["keys"] == p["keys"])
    same = same.when(g["type"] == "scroll", g["amount"].eqNullSafe(p["amount"]) & g["way"].eqNullSafe(p["way"])).when(g["type"] == "wait", g["seconds"] == p["seconds"]).otherwise(g["status"] == p["status"])
    tool = F.coalesce(g["type"] == p["type"], F.lit(False))
    far = F.hypot(p["x"] - g["x"], p["y"] - g["y"]) / F.greatest(F.abs(g["x"]), F.abs(g["y"]), F.lit(1.0))
    j = j.select("case_id", "ng", "np", p.isNotNull().alias("met"), tool.alias("tool"), (tool & F.coalesce(same, F.lit(False))).alias("exact"), F.when(tool & point, F.greatest(F.lit(0.0), 1 - far)).alias("near"), F.when(tool & point & (F.size(g["boxes"]) > 0), in_boxes(p["x"], p["y"], g["boxes"]).cast("int")).alias("hit"))
    per = j.groupBy("case_id").agg(F.first("ng").alias("ng"), F.first("np").alias("np"), *[F.count_if(c).alias(c) for c in ("met", "tool", "exact")], *[f(c).alias(f"{c}_{n}") for c in ("near", "hit") for f, n in ((F.sum, "sum"), (F.count, "n"))])
    return per.agg(
        F.sum("ng").alias("expected"), F.sum("np").alias("predicted"), F.sum("met").alias("compared"), ratio(F.sum("tool"), F.sum("ng")).alias("tool_accuracy"), ratio(F.sum("exact"), F.sum("ng")).alias("exact_accuracy"),
        ratio(F.sum("near_sum"), F.sum("near_n")).alias("coordinate_score"), ratio(F.sum("hit_sum"), F.sum("hit_n")).alias("box_hits"), F.count_if((F.col("ng") == F.col("np")) & (F.col("exact") == F.col("ng"))).alias("exact_trajectories"),
    )


_STRIP = r"regexp_replace(lower(coalesce({}, '')), '^\s+|\s+$', '', 'g')"
_WAY = lambda a, w: f"coalesce(sign({a})::INT, CASE WHEN lower(trim({w})) IN ('up', 'positive', 'right') THEN 1 WHEN lower(trim({w})) IN ('down', 'negative', 'left') THEN -1 ELSE coalesce(sign(TRY_CAST(trim({w}) AS DOUBLE))::INT, 0) END, 0)"
STREAM = rf"""{ACTIONS}, keyed AS (SELECT * EXCLUDE (type, key), lower(type) AS t, CASE WHEN lower(type) = 'hotkey' AND key <> 'Enter' THEN ['ctrl', lower(key)] ELSE [lower(key)] END AS keys FROM acts),
e AS (SELECT *, (t = 'press' OR t = 'hotkey' AND side = 'gold') AND len(keys) = 1 AND keys[1] IN ('enter', 'return') AS enter FROM keyed),
w AS (SELECT *, enter AND coalesce(lag(t) OVER o = 'write', false) AS gone, t = 'write' AND coalesce(lead(enter) OVER o, false) AS entered FROM e WINDOW o AS (PARTITION BY case_id, side ORDER BY pos)),
m AS (SELECT * EXCLUDE (pos, text), row_number() OVER (PARTITION BY case_id, side ORDER BY pos) AS pos, text || CASE WHEN entered THEN chr(10) ELSE '' END AS text FROM w WHERE NOT gone),
n AS (SELECT case_id, count(*) FILTER (WHERE side = 'gold') AS n_gold, count(*) FILTER (WHERE side = 'pred') AS n_pred, max(t) FILTER (WHERE side = 'gold' AND pos = 1) AS g1, max(status) FILTER (WHERE side = 'gold' AND pos = 1) AS gs,
  max(t) FILTER (WHERE side = 'pred' AND pos = 1) AS p1, max(status) FILTER (WHERE side = 'pred' AND pos = 1) AS ps, list(t) FILTER (WHERE side = 'gold') AS kinds FROM m GROUP BY case_id),
c AS (SELECT *, n_pred = 0 AS empty_, CASE WHEN n_pred > n_gold THEN n_gold / n_pred ELSE 1.0 END AS penalty, n_pred > 0 AND CASE WHEN g1 = 'terminate' THEN p1 = 'terminate' ELSE list_contains(kinds, p1) END AS first FROM n),
v AS (SELECT g.case_id, g.t, CASE WHEN p.t IS NULL OR p.t <> g.t THEN 0
  WHEN g.t IN ('click', 'doubleclick') THEN CASE WHEN g.boxed AND p.x BETWEEN g.x - 0.005 AND g.x - 0.005 + 0.05 AND p.y BETWEEN g.y - 0.005 AND g.y - 0.005 + 0.05 OR sqrt((p.x - g.x) ** 2 + (p.y - g.y) ** 2) <= {NEAR} THEN 1 ELSE exp(-{DECAY} * (sqrt((p.x - g.x) ** 2 + (p.y - g.y) ** 2) - {NEAR})) END
  WHEN g.t = 'write' THEN least(1, (1 - levenshtein({_STRIP.format("p.text")}, {_STRIP.format("g.text")}) / greatest(length({_STRIP.format("p.text")}), length({_STRIP.format("g.text")}))) / {SIMILAR})
  WHEN g.t IN ('press', 'hotkey') THEN (p.keys = g.keys)::INT
  WHEN g.t = 'scroll' THEN CASE WHEN {_WAY("g.amount", "g.way")} <> 0 AND {_WAY("g.amount", "g.way")} <> {_WAY("p.amount", "p.way")} THEN 0 WHEN g.amount IS NOT NULL AND p.amount IS NOT NULL THEN CASE WHEN greatest(abs(g.amount), abs(p.amount)) = 0 THEN 1 ELSE least(abs(g.amount), abs(p.amount)) / greatest(abs(g.amount), abs(p.amount)) END ELSE ({_WAY("g.amount", "g.way")} = {_WAY("p.amount", "p.way")})::INT END
  WHEN g.t = 'wait' THEN (p.seconds = g.seconds)::INT ELSE 0 END AS s FROM m g LEFT JOIN m p ON p.case_id = g.case_id AND p.side = 'pred' AND p.pos = g.pos WHERE g.side = 'gold'),
ty AS (SELECT case_id, t AS type, CASE WHEN first THEN avg(s) * any_value(penalty) ELSE 0 END AS score FROM v JOIN c USING (case_id) WHERE NOT empty_ AND g1 <> 'terminate' AND (t <> 'terminate' OR NOT first) GROUP BY case_id, t, first
  UNION ALL SELECT case_id, 'terminate', CASE WHEN p1 = 'terminate' AND ps = gs THEN penalty ELSE 0 END FROM c WHERE NOT empty_ AND g1 = 'terminate'),
raw AS (SELECT case_id, count(*) FILTER (WHERE side = 'gold') AS g, count(*) FILTER (WHERE side = 'pred') AS p FROM acts GROUP BY case_id),
sc AS (SELECT case_id, coalesce(total, 0) AS total, first, CASE WHEN empty_ THEN 1 ELSE penalty END AS penalty, CASE WHEN empty_ THEN g ELSE n_gold END AS n_gold, CASE WHEN empty_ THEN p ELSE n_pred END AS n_pred FROM c JOIN raw USING (case_id) LEFT JOIN (SELECT case_id, avg(score) AS total FROM ty GROUP BY case_id) USING (case_id))"""


def _streams(spark, sf_dir):
    return actions(spark, sf_dir).select("case_id", stream_score(F.col("gold"), F.col("pred")).alias("s")).select("case_id", "s.*")


@query(f"WITH {STREAM} SELECT case_id, first, round(total, 6) AS total, round(penalty, 6) AS penalty, n_gold, n_pred FROM sc")
def ev_agent_stream(spark, sf_dir):
    """Score of each stream of screen actions: a write and the enter behind it merged, gate on the first type, penalty for predicting too many, means per type, then over types.

    A case without predictions scores 0.
    """
    n = lambda c: F.col(c).cast("long").alias(c)
    return _streams(spark, sf_dir).select("case_id", "first", F.round("total", 6).alias("total"), F.round("penalty", 6).alias("penalty"), n("n_gold"), n("n_pred"))


@query(f"""WITH {STREAM} SELECT 'all' AS type, count(*) AS n, round(avg(total), 6) AS score, round(avg((total >= 1 - {CLOSE})::INT), 6) AS success_rate, round(avg((total = 1)::INT), 6) AS exact_rate, round(avg(first::INT), 6) AS first_rate, round(avg(penalty), 6) AS penalty, round(avg(n_gold), 6) AS n_gold, round(avg(n_pred), 6) AS n_pred FROM sc
UNION ALL SELECT type, count(*), round(avg(score), 6), NULL, NULL, NULL, NULL, NULL, NULL FROM ty GROUP BY type""")
def ev_agent_summary(spark, sf_dir):
    """Means over all streams, and of each action type's scores over the streams that ask for it."""
    s = _streams(spark, sf_dir)
    mean = lambda c: F.round(F.avg(c), 6)
    total = F.struct(F.lit("all").alias("type"), F.col("total").alias("score"), "total", "first", "penalty", "n_gold", "n_pred")
    each = F.transform("by_type", lambda t: F.struct(t["type"], t["score"], *[F.lit(None).cast(k).alias(c) for c, k in (("total", "double"), ("first", "boolean"), ("penalty", "double"), ("n_gold", "int"), ("n_pred", "int"))]))
    r = s.select(F.inline(F.concat(F.array(total), each)))
    return r.groupBy("type").agg(
        F.count("*").alias("n"), mean("score").alias("score"), mean((F.col("total") >= 1 - CLOSE).cast("int")).alias("success_rate"), mean((F.col("total") == 1).cast("int")).alias("exact_rate"),
        mean(F.col("first").cast("int")).alias("first_rate"), mean("penalty").alias("penalty"), mean("n_gold").alias("n_gold"), mean("n_pred").alias("n_pred"),
    )


@query(f"""WITH {TRIALS}, t AS (SELECT task_id, 's' || task_id % 5 AS service, bool_or(success) FILTER (WHERE run = 1) AS one, bool_or(success) AS any_run, bool_and(success) AS every, avg(success::INT) AS rate FROM trials WHERE run <= 4 GROUP BY task_id HAVING count(*) = 4)
SELECT coalesce(service, 'all') AS service, count(*) AS tasks, round(avg(one::INT), 6) AS pass_at_1, round(avg(any_run::INT), 6) AS pass_at_4, round(avg(every::INT), 6) AS pass_all_4, round(avg(rate), 6) AS mean_run_rate FROM t GROUP BY ROLLUP (service)""")
def ev_pass_at_k(spark, sf_dir):
    """First run, any and all of four runs, for each service and over all tasks, each task alike. A task with fewer runs fails the query."""
    t = trials(spark, sf_dir).filter("run <= 4").groupBy("task_id").agg(F.bool_or(F.when(F.col("run") == 1, F.col("success"))).alias("one"), F.bool_or("success").alias("some"), F.bool_and("success").alias("every"), F.avg(F.col("success").cast("int")).alias("rate"), F.count("*").alias("runs"))
    t = t.withColumn("service", F.when(F.assert_true(F.col("runs") == 4, "a task lacks runs").isNull(), F.concat(F.lit("s"), (F.col("task_id") % 5).cast("string"))))
    m = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    r = t.withColumns({c: F.col(c).cast("int") for c in ("one", "some", "every")}).rollup("service").agg(F.count("*").alias("tasks"), m("one").alias("pass_at_1"), m("some").alias("pass_at_4"), m("every").alias("pass_all_4"), m("rate").alias("mean_run_rate"))
    return r.withColumn("service", F.coalesce("service", F.lit("all")))


@query(f"""WITH {TRIALS}, t AS (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE success) AS s FROM trials WHERE NOT infra GROUP BY task_id), k AS (SELECT unnest(generate_series(1, (SELECT min(n) FROM t))) AS k)
SELECT k, count(*) AS tasks, round(avg(list_product([greatest(s - i, 0) / (n - i) for i in generate_series(0, k - 1)])), 6) AS pass_hat FROM t, k GROUP BY k""")
def ev_pass_hat_k(spark, sf_dir):
    """Unbiased pass^k for k up to the smallest task, infrastructure errors left out."""
    t = trials(spark, sf_dir).filter("NOT infra").groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("success").alias("s"))
    top = t.agg(F.min("n").alias("top"))
    j = t.crossJoin(F.broadcast(top)).select("n", "s", F.explode(F.sequence(F.lit(1).cast("long"), "top")).alias("k"))  # one row
    return j.groupBy("k").agg(F.count("*").alias("tasks"), F.round(F.avg(pass_hat(F.col("s"), F.col("n"), F.col("k"))), 6).alias("pass_hat"))


@query(f"WITH {TRIALS} SELECT coalesce(task_id, -1) AS task_id, count(*) AS episodes, round(avg((reward >= 1)::INT), 6) AS success_rate, round(avg(reward), 6) AS mean_reward, count(*) FILTER (WHERE infra) AS errors FROM trials GROUP BY ROLLUP (task_id)")
def ev_episode_summary(spark, sf_dir):
    r = trials(spark, sf_dir).rollup("task_id").agg(F.count("*").alias("episodes"), F.round(F.avg((F.col("reward") >= 1).cast("int")), 6).alias("success_rate"), F.round(F.avg("reward"), 6).alias("mean_reward"), F.count_if("infra").alias("errors"))
    return r.withColumn("task_id", F.coalesce("task_id", F.lit(-1)))


@query(f"WITH {TRIALS} SELECT task_id % 10 AS template, count(*) AS episodes, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE infra) AS exceptions, round(avg(seconds) FILTER (WHERE NOT infra), 6) AS mean_seconds FROM trials GROUP BY 1")
def ev_template_summary(spark, sf_dir):
    t = trials(spark, sf_dir)
    return t.groupBy((F.col("task_id") % 10).alias("template")).agg(F.count("*").alias("episodes"), F.count_if("success").alias("successes"), F.count_if("infra").alias("exceptions"), F.round(F.avg(F.when(~F.col("infra"), F.col("seconds"))), 6).alias("mean_seconds"))


@query("""WITH s AS (SELECT p_retailprice / 3000 AS sim, string_split(p_type, ' ') AS cats FROM part), f AS (SELECT sim, CASE WHEN list_contains(cats, 'BRASS') THEN [c for c in cats if c <> 'SMALL'] ELSE cats END AS cats FROM s)
SELECT category, count(*) AS n, round(avg(sim), 6) AS similarity FROM (SELECT sim, unnest(list_append(list_distinct(cats), 'ALL')) AS category FROM f) GROUP BY category""")
def ev_multilabel_summary(spark, sf_dir):
    """Rows count in each of their categories and in ALL; SMALL is suppressed where BRASS is present."""
    c = F.split("p_type", " ")
    cats = F.when(F.array_contains(c, "BRASS"), F.filter(c, lambda x: x != "SMALL")).otherwise(c)
    p = table(spark, sf_dir, "part").select((F.col("p_retailprice") / 3000).alias("sim"), F.explode(F.array_union(cats, F.array(F.lit("ALL")))).alias("category"))
    return p.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("similarity"))


@query("""WITH e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0), o AS (SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 13 <> 0)
SELECT (SELECT count(*) FROM e WHERE k NOT IN (SELECT k FROM o)) AS missing, (SELECT count(DISTINCT k) FROM o WHERE k NOT IN (SELECT k FROM e)) AS unexpected, (SELECT count(*) FROM (SELECT k FROM o GROUP BY k HAVING count(*) > 1)) AS duplicate""")
def ev_completeness(spark, sf_dir):
    """Expected against observed case keys, in one full outer join of counts."""
    e = table(spark, sf_dir, "orders").filter("o_orderkey % 11 <> 0").groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("want"))
    o = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_orderkey % 13 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("got"))
    return e.join(o, "k", "full_outer").agg(F.count_if(F.col("got").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unexpected"), F.count_if(F.col("got") > 1).alias("duplicate"))


TOP = """n AS (SELECT vec_id, label, embedding, sqrt(list_sum([x::DOUBLE * x for x in embedding])) AS norm FROM embeddings),
s AS (SELECT q.vec_id AS query_id, q.label AS gold, c.vec_id, c.label, round(list_sum([q.embedding[i]::DOUBLE * c.embedding[i] for i in generate_series(1, len(q.embedding))]) / (q.norm * c.norm), 6) AS score FROM n q, n c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10)"""


def _ranked(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    top = cosine_topk(e.filter("vec_id % 20 = 0"), e, 10)
    of = e.select("vec_id", "label")
    return top.join(of.hint("merge"), "vec_id").join(of.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold")).hint("merge"), "query_id")


@query(f"WITH {TOP}, f AS (SELECT query_id, min(rank) FILTER (WHERE label = gold) AS rank, bool_or(label = gold) FILTER (WHERE rank = 1) AS top FROM r GROUP BY query_id) SELECT count(*) AS queries, round(avg(coalesce(rank <= 10, false)::INT), 6) AS recall_at_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(top::INT), 6) AS top_1 FROM f")
def ev_retrieval(spark, sf_dir):
    f = _ranked(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("gold"), F.col("rank"))).alias("rank"))
    return f.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(F.col("rank") <= 10, F.lit(False)).cast("int")), 6).alias("recall_at_10"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce(F.col("rank") == 1, F.lit(False)).cast("int")), 6).alias("top_1"))


@query(f"""WITH {TOP}, f AS (SELECT query_id, any_value(gold) AS domain, min(rank) FILTER (WHERE label IN (gold, (gold + 1) % 10)) AS rank FROM r GROUP BY query_id)
SELECT coalesce(domain, -1) AS domain, count(*) AS tasks, round(avg(coalesce(rank <= 1, false)::INT), 6) AS hit_1, round(avg(coalesce(rank <= 3, false)::INT), 6) AS hit_3, round(avg(coalesce(rank <= 5, false)::INT), 6) AS hit_5 FROM f GROUP BY ROLLUP (domain)""")
def ev_hit_at_k(spark, sf_dir):
    """hit@1/3/5 against a gold set (the label and the next one), overall and by domain."""
    ok = (F.col("label") == F.col("gold")) | (F.col("label") == (F.col("gold") + 1) % 10)
    f = _ranked(spark, sf_dir).groupBy("query_id").agg(F.first("gold").alias("domain"), F.min(F.when(ok, F.col("rank"))).alias("rank"))
    hit = lambda k: F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), 6)
    r = f.rollup("domain").agg(F.count("*").alias("tasks"), hit(1).alias("hit_1"), hit(3).alias("hit_3"), hit(5).alias("hit_5"))
    return r.withColumn("domain", F.coalesce("domain", F.lit(-1)))


@query("WITH c AS (SELECT l_linenumber AS n, avg((l_returnflag = 'N')::INT) AS acc FROM lineitem GROUP BY 1) SELECT n, round(acc, 6) AS accuracy, n = (SELECT min(n) FROM c WHERE acc >= (SELECT max(acc) FROM c) - 0.03) AS knee FROM c")
def ev_curve_knee(spark, sf_dir):
    """Accuracy per number of examples; the knee is the first within three points of the best."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("n")).agg(F.avg((F.col("l_returnflag") == "N").cast("int")).alias("acc"))
    w = Window.partitionBy()  # one row a setting
    c = c.withColumn("ok", F.col("acc") >= F.max("acc").over(w) - 0.03)
    return c.select("n", F.round("acc", 6).alias("accuracy"), (F.col("n") == F.min(F.when(F.col("ok"), F.col("n"))).over(w)).alias("knee"))


@query(f"WITH {SCORED} SELECT arm, grp, round(sum(nll) / sum(tokens), 6) AS cross_entropy, round(sum(nll) / (ln(2) * sum(bytes)), 6) AS bits_per_byte, round(sum(correct) / sum(tokens), 6) AS top_1 FROM scored GROUP BY arm, grp")
def ev_lm_rollup(spark, sf_dir):
    s = scored(spark, sf_dir).groupBy("arm", "grp").agg(F.sum("nll").alias("l"), F.sum("tokens").alias("t"), F.sum("bytes").alias("b"), F.sum("correct").alias("c"))
    return s.select("arm", "grp", ratio(F.col("l"), F.col("t")).alias("cross_entropy"), ratio(F.col("l"), F.log(F.lit(2.0)) * F.col("b")).alias("bits_per_byte"), ratio(F.col("c"), F.col("t")).alias("top_1"))


@query(f"WITH {TRIALS}, g AS (SELECT event_id, reward, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS s FROM trials WINDOW w AS (PARTITION BY task_id)) SELECT event_id, round((reward - m) / (s + 1e-6), 4) AS advantage FROM g WHERE s >= 1e-6")
def ev_group_advantage(spark, sf_dir):
    t = trials(spark, sf_dir)
    g = t.groupBy("task_id").agg(F.avg("reward").alias("m"), F.stddev_pop("reward").alias("s")).filter("s >= 1e-6")
    return t.join(g, "task_id").select("event_id", F.round((F.col("reward") - F.col("m")) / (F.col("s") + 1e-6), 4).alias("advantage"))


#: gate, metric, comparator, threshold.
GATES = (("exact", "exact", ">=", 0.66), ("latency", "mean_ms", "<=", 60.0), ("invalid", "invalid", "<=", 1e6), ("families", "others", "==", 0.0), ("unseen", "unseen", "<=", 1.0), ("unset", "unseen", "==", None))


@query(f"""WITH {LATENCY}, m AS (SELECT family, avg(exact::INT) AS exact, avg(ms) AS mean_ms, nullif(count(*) FILTER (WHERE NOT valid), 0)::DOUBLE AS invalid, (count(DISTINCT family) - 1)::DOUBLE AS others, NULL::DOUBLE AS unseen FROM attempts GROUP BY family),
g AS (SELECT * FROM (VALUES {", ".join(f"('{g}', '{m}', '{c}', {'NULL' if t is None else t}::DOUBLE)" for g, m, c, t in GATES)}) v(gate, metric, comparator, threshold)),
j AS (SELECT family, gate, comparator, threshold, CASE metric WHEN 'exact' THEN exact WHEN 'mean_ms' THEN mean_ms WHEN 'invalid' THEN invalid WHEN 'others' THEN others ELSE unseen END AS observed FROM m, g),
p AS (SELECT *, CASE comparator WHEN '>=' THEN coalesce(observed >= threshold, false) WHEN '<=' THEN coalesce(observed <= threshold, false) ELSE observed IS NOT DISTINCT FROM threshold END AS passed FROM j)
SELECT family, gate, comparator, threshold, round(observed, 6) AS observed, passed, bool_and(passed) OVER (PARTITION BY family) AS ready FROM p""")
def ev_gate_table(spark, sf_dir):
    """Metrics of each family against a table of gates; a null observation fails >= and <=, and equals a null threshold only."""
    x = attempts(spark, sf_dir)
    m = x.groupBy("family").agg(F.avg(F.col("exact").cast("int")).alias("exact"), F.avg("ms").alias("mean_ms"), F.nullif(F.count_if(~F.col("valid")), F.lit(0)).cast("double").alias("invalid"), (F.count_distinct("family") - 1).cast("double").alias("others"))
    m = m.withColumn("unseen", F.lit(None).cast("double"))
    return gate_table(m, "family", spark.createDataFrame(GATES, "gate string, metric string, comparator string, threshold double")).withColumn("observed", F.round("observed", 6))


@query(f"""WITH {TRIALS}, c AS (SELECT task_id AS candidate, avg(success::INT) AS seq, avg(reward) AS tok, avg(seconds) AS loss, count(*) AS steps FROM trials GROUP BY task_id), b AS (SELECT avg(success::INT) AS seq, avg(reward) AS tok, avg(seconds) AS loss FROM trials)
SELECT candidate, round(c.seq - b.seq, 6) AS delta FROM c, b WHERE c.seq >= b.seq - 0.02 AND c.tok >= b.tok - 0.02 AND c.loss <= b.loss * 1.1 ORDER BY c.seq DESC, c.tok DESC, c.loss, steps, candidate LIMIT 1""")
def ev_best_candidate(spark, sf_dir):
    """Best candidate that isn't inferior to the baseline (all trials) on any of three gates; none if none is eligible."""
    t = trials(spark, sf_dir)
    parts = [F.avg(F.col("success").cast("int")).alias("seq"), F.avg("reward").alias("tok"), F.avg("seconds").alias("loss")]
    b = t.agg(*parts).toDF("bseq", "btok", "bloss")
    c = t.groupBy(F.col("task_id").alias("candidate")).agg(*parts, F.count("*").alias("steps")).crossJoin(F.broadcast(b))
    ok = (F.col("seq") >= F.col("bseq") - 0.02) & (F.col("tok") >= F.col("btok") - 0.02) & (F.col("loss") <= F.col("bloss") * 1.1)
    return c.filter(ok).orderBy(F.desc("seq"), F.desc("tok"), "loss", "steps", "candidate").limit(1).select("candidate", F.round(F.col("seq") - F.col("bseq"), 6).alias("delta"))


@query(f"WITH {LATENCY} SELECT family, round(avg(ms) FILTER (WHERE event_id % 2 = 0) - avg(ms) FILTER (WHERE event_id % 2 = 1), 6) AS delta_ms FROM attempts GROUP BY family")
def ev_surface_delta(spark, sf_dir):
    """Warm against control per surface."""
    a = attempts(spark, sf_dir)
    side = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("ms")))
    return a.groupBy("family").agg(F.round(side(0) - side(1), 6).alias("delta_ms"))


@query(f"WITH {LATENCY} SELECT family, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.9), 6) AS p90 FROM attempts GROUP BY family")
def st_percentile(spark, sf_dir):
    q = quantiles(attempts(spark, sf_dir), "family", "ms", {"p50": 0.5, "p90": 0.9})
    return q.select("family", *[F.round(k, 6).alias(k) for k in ("p50", "p90")])


@query(f"WITH {LATENCY} SELECT count(*) AS n, min(ms) AS low, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, max(ms) AS high FROM attempts")
def st_latency(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("every", F.lit(1))
    q = quantiles(a, "every", "ms", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).drop("every")
    s = a.agg(F.count("*").alias("n"), F.min("ms").alias("low"), F.round(F.avg("ms"), 6).alias("mean"), F.max("ms").alias("high"))
    return s.crossJoin(F.broadcast(q)).select("n", "low", "mean", *[F.round(k, 6).alias(k) for k in ("p50", "p90", "p95", "p99")], "high")  # one row each


DEADLINE = "count(*) AS n, round(avg((ms <= d)::INT), 6) AS on_time, round(avg((exact AND valid AND ms <= d)::INT), 6) AS success_at_deadline, round(count(*) FILTER (WHERE exact AND valid AND ms <= d) / nullif(sum(ms) / 60000, 0), 6) AS useful_per_minute"


def _deadlines(a, *keys):
    d = a.withColumn("d", F.explode(F.array(*[F.lit(float(x)) for x in (20, 50, 80)])))
    ok = F.col("exact") & F.col("valid") & (F.col("ms") <= F.col("d"))
    return d.groupBy(*keys, F.col("d").alias("deadline")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("ms") <= F.col("d")).cast("int")), 6).alias("on_time"), F.round(F.avg(ok.cast("int")), 6).alias("success_at_deadline"), ratio(F.count_if(ok), F.sum("ms") / 60000).alias("useful_per_minute"))


@query(f"WITH {LATENCY} SELECT d AS deadline, {DEADLINE} FROM attempts, (VALUES (20.0::DOUBLE), (50.0), (80.0)) v(d) GROUP BY d")
def st_deadline(spark, sf_dir):
    return _deadlines(attempts(spark, sf_dir))


@query(f"WITH {LATENCY} SELECT family, d AS deadline, {DEADLINE} FROM attempts, (VALUES (20.0::DOUBLE), (50.0), (80.0)) v(d) GROUP BY family, d")
def st_deadline_grouped(spark, sf_dir):
    return _deadlines(attempts(spark, sf_dir), "family")


MACRO = f"{LATENCY}, cm AS (SELECT case_id, avg((exact AND valid AND ms <= 50)::INT) AS v, count(*) FILTER (WHERE exact AND valid AND ms <= 50) AS s, count(*) AS n FROM attempts GROUP BY case_id)"


def _macro(spark, sf_dir):
    ok = F.col("exact") & F.col("valid") & (F.col("ms") <= 50)
    return attempts(spark, sf_dir).groupBy("case_id").agg(F.avg(ok.cast("int")).alias("v"), F.count_if(ok).alias("s"), F.count("*").alias("n"))


@query(f"WITH {MACRO} SELECT count(*) AS cases, round(avg(v), 6) AS macro, round(sum(s) / sum(n), 6) AS micro FROM cm")
def st_case_macro(spark, sf_dir):
    return _macro(spark, sf_dir).agg(F.count("*").alias("cases"), F.round(F.avg("v"), 6).alias("macro"), ratio(F.sum("s"), F.sum("n")).alias("micro"))


# A resample r draws each of n clusters with index hash(seed, r, draw) mod n: the same draws in any engine.
DRAWS = "ix AS (SELECT *, row_number() OVER (ORDER BY case_id) - 1 AS k, count(*) OVER () AS m FROM {t}), dr AS (SELECT r, ('0x' || substr(sha256('11:' || r || ':' || i), 1, 15))::BIGINT % (SELECT max(m) FROM ix) AS k FROM generate_series(0, 199) a(r), generate_series(0, (SELECT max(m) FROM ix) - 1) b(i))"


@query(f"WITH {MACRO}, {DRAWS.format(t='cm')}, s AS (SELECT r, avg(v) AS m FROM dr JOIN ix USING (k) GROUP BY r) SELECT count(*) AS resamples, round(quantile_cont(m, 0.025), 6) AS low, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS high FROM s")
def st_bootstrap(spark, sf_dir):
    """Percentile bootstrap of the mean over cases, 200 resamples."""
    s = resampling.bootstrap(_macro(spark, sf_dir), "case_id", 200, 11).agg(F.avg("v").alias("m"))
    return s.agg(F.count("*").alias("resamples"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", 0.975), 6).alias("high"))


PAIRED = f"{LATENCY}, pr AS (SELECT case_id, avg((exact AND ms <= 50)::INT) FILTER (WHERE event_id % 2 = 0) - avg((exact AND ms <= 50)::INT) FILTER (WHERE event_id % 2 = 1) AS v FROM attempts GROUP BY case_id)"


@query(f"WITH {PAIRED}, pq AS (SELECT * FROM pr WHERE v IS NOT NULL), {DRAWS.format(t='pq')}, s AS (SELECT r, avg(v) AS m FROM dr JOIN ix USING (k) GROUP BY r) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS high, quantile_cont(m, 0.025) > -0.05 AS non_inferior FROM s")
def st_paired_delta(spark, sf_dir):
    """Candidate minus baseline per case (even against odd attempts), resampled by case; margin -0.05."""
    ok = (F.col("exact") & (F.col("ms") <= 50)).cast("int")
    side = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, ok))
    p = attempts(spark, sf_dir).groupBy("case_id").agg((side(0) - side(1)).alias("v")).filter("v IS NOT NULL")
    s = resampling.bootstrap(p, "case_id", 200, 11).agg(F.avg("v").alias("m"))
    low = F.percentile("m", 0.025)
    return s.agg(F.round(low, 6).alias("low"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", 0.975), 6).alias("high"), (low > -0.05).alias("non_inferior"))


RATIO = f"{SCORED}, pz AS (SELECT grp AS case_id, sum(CASE arm WHEN 'a' THEN nll ELSE -nll END) AS delta, sum(tokens) / 2 AS tokens, sum(bytes) / 2 AS bytes FROM scored GROUP BY grp)"


@query(f"""WITH {RATIO}, {DRAWS.format(t='pz')}, s AS (SELECT r, sum(delta) / sum(tokens) AS ce, sum(delta) / (ln(2) * sum(bytes)) AS bpb FROM dr JOIN ix USING (k) GROUP BY r)
SELECT round(quantile_cont(ce, 0.025), 6) AS ce_low, round(quantile_cont(ce, 0.975), 6) AS ce_high, round(quantile_cont(bpb, 0.025), 6) AS bpb_low, round(quantile_cont(bpb, 0.975), 6) AS bpb_high, round(avg((ce > 0)::INT), 6) AS win_share FROM s""")
def st_paired_ratio(spark, sf_dir):
    """Ratios of sums of paired differences, resampled by cluster (source)."""
    p = scored(spark, sf_dir).groupBy(F.col("grp").alias("case_id")).agg(F.sum(F.when(F.col("arm") == "a", F.col("nll")).otherwise(-F.col("nll"))).alias("delta"), (F.sum("tokens") / 2).alias("t"), (F.sum("bytes") / 2).alias("b"))
    s = resampling.bootstrap(p, "case_id", 200, 11).agg((F.sum("delta") / F.sum("t")).alias("ce"), (F.sum("delta") / (F.log(F.lit(2.0)) * F.sum("b"))).alias("bpb"))
    q = lambda c, p: F.round(F.percentile(c, p), 6)
    return s.agg(q("ce", 0.025).alias("ce_low"), q("ce", 0.975).alias("ce_high"), q("bpb", 0.025).alias("bpb_low"), q("bpb", 0.975).alias("bpb_high"), F.round(F.avg((F.col("ce") > 0).cast("int")), 6).alias("win_share"))


@query(f"WITH {TRIALS}, s AS (SELECT task_id % 8 AS seed, avg(reward) AS m FROM trials GROUP BY 1) SELECT count(*) AS seeds, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(stddev_samp(m), 6) AS sd, round(stddev_samp(m) / sqrt(count(*)), 6) AS se, round(min(m), 6) AS low, round(max(m), 6) AS high FROM s")
def st_seed_summary(spark, sf_dir):
    s = trials(spark, sf_dir).groupBy((F.col("task_id") % 8).alias("seed")).agg(F.avg("reward").alias("m"))
    r = lambda c: F.round(c, 6)
    return s.agg(F.count("*").alias("seeds"), r(F.avg("m")).alias("mean"), r(F.median("m")).alias("median"), r(F.stddev_samp("m")).alias("sd"), r(F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se"), r(F.min("m")).alias("low"), r(F.max("m")).alias("high"))


@query(f"""WITH {PAIRED}, w AS (SELECT count(*) FILTER (WHERE v > 0) AS wins, count(*) FILTER (WHERE v < 0) AS losses FROM pr),
t AS (SELECT wins, losses, CASE WHEN wins + losses = 0 THEN 1 ELSE list_sum([exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2)) for k in generate_series(wins, wins + losses)]) END AS one, CASE WHEN wins + losses = 0 THEN 1 ELSE list_sum([exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2)) for k in generate_series(greatest(wins, losses), wins + losses)]) END AS top FROM w)
SELECT wins, losses, round(one, 6) AS p_one_sided, round(least(1, 2 * top), 6) AS p_two_sided FROM t""")
def st_sign_test(spark, sf_dir):
    ok = (F.col("exact") & (F.col("ms") <= 50)).cast("int")
    side = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, ok))
    p = attempts(spark, sf_dir).groupBy("case_id").agg((side(0) - side(1)).alias("v"))
    w = p.agg(F.count_if(F.col("v") > 0).alias("wins"), F.count_if(F.col("v") < 0).alias("losses"))
    big, small = F.greatest("wins", "losses"), F.least("wins", "losses")
    return w.select("wins", "losses", F.round(sign_test(F.col("wins"), F.col("losses")), 6).alias("p_one_sided"), F.round(F.least(F.lit(1.0), 2 * sign_test(big, small)), 6).alias("p_two_sided"))


@query(f"WITH {LATENCY}, r AS (SELECT family, case_id, quantile_cont(ms, 0.9) AS p90 FROM attempts GROUP BY ALL) SELECT family, count(*) AS runs, round(median(p90), 6) AS median_p90, median(p90) <= 80 AS pass FROM r GROUP BY family")
def st_run_condition(spark, sf_dir):
    """Percentiles per run, their median per condition, and a gate. Both come from counts by value, so that no hot run is one task."""
    r = quantiles(attempts(spark, sf_dir).select(F.struct("family", "case_id").alias("run"), "ms"), "run", "ms", {"p90": 0.9}).select("run.family", "p90")
    m = quantiles(r, "family", "p90", {"median_p90": 0.5})
    n = r.groupBy("family").agg(F.count("*").alias("runs"))
    return n.join(m.hint("merge"), "family").select("family", "runs", F.round("median_p90", 6).alias("median_p90"), (F.col("median_p90") <= 80).alias("pass"))


