"""Queries of the composite index, evaluation and attribution operators."""

from pyspark.sql import functions as F

from ..operators import attribution, clusters, evaluation, index_score, models, penalised, scale
from ..sources import bindings
from .registry import query
from .sqlbase import USER_DAYS, with_ctes

r = F.round
FEATURES = bindings.INDEX_FEATURES
WAYS = {f: ("MIN" if f in ("errors", "hours") else "MAX") for f in FEATURES}
WEIGHTS = dict(zip(FEATURES, [0.9, 0.8, 0.7, 0.95, 0.6, 0.85]))
GROUPS = {"Behavior": ["views", "carts", "signups"], "Transactional": ["other_value"], "visual": ["hours"], "KPI": ["errors"]}


def _norm(spark, sf, ways=WAYS):
    return index_score.normalised(bindings.user_days(spark, sf), ways)


def _scored(spark, sf):
    return _norm(spark, sf).withColumn("composite_index", r(index_score.score(WEIGHTS), 6))


NORM = "tp AS (SELECT " + ", ".join(f"max({f}) AS t_{f}" for f in FEATURES) + " FROM ud),\nnm AS (SELECT user_pseudo_id, day, outcome, spend, " + ", ".join(
    f"(t_{f} - {f}) / t_{f} AS {f}" if WAYS[f] == "MIN" else f"{f} / t_{f} AS {f}" for f in FEATURES) + " FROM ud, tp)"


def _dot(weights):
    return "(" + " + ".join(f"{f} * {w!r}::DOUBLE" for f, w in weights.items()) + f") * 100 / {len(weights)}"


SCORE = f"sc AS (SELECT *, round({_dot(WEIGHTS)}, 6) AS s FROM nm), sm AS (SELECT avg(s) AS m FROM sc)"
BASE = (USER_DAYS, NORM, SCORE)


@query("d1_feature_directions", with_ctes(USER_DAYS, " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CASE WHEN corr({f}, outcome) < 0 THEN 'MIN' ELSE 'MAX' END AS direction, count(*) AS n FROM ud" for f in FEATURES)))
def d1(spark, sf):
    ud = bindings.user_days(spark, sf)
    ways = index_score.correlation_directions(ud, "outcome", FEATURES)
    cells = [F.struct(F.lit(f).alias("feature"), F.lit(w).alias("direction"), F.count("*").alias("n")) for f, w in ways.items()]
    return ud.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))


def _descent_sql(penalty, sweeps=60):
    """Coordinate descent on the co-moments, one coordinate a step of the recursion."""
    n = len(FEATURES)
    gram = ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in FEATURES) + "]" for a in FEATURES)
    cross = ", ".join(f"covar_pop({a}, outcome)" for a in FEATURES)
    return [f"gm AS (SELECT [{gram}] AS g, [{cross}] AS x FROM (SELECT {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)}, CAST(outcome AS DOUBLE) AS outcome FROM ud))",
            f"""cd AS (SELECT 0 AS step, {[0.0] * n}::DOUBLE[] AS w UNION ALL
      SELECT step + 1, [CASE WHEN i = j THEN sign(pull) * greatest(abs(pull) - {penalty}::DOUBLE, 0) / g[j][j] ELSE w[i] END FOR i IN generate_series(1, {n})]
      FROM (SELECT step, w, g, step % {n} + 1 AS j, x[step % {n} + 1] - list_inner_product(g[step % {n} + 1], w) + g[step % {n} + 1][step % {n} + 1] * w[step % {n} + 1] AS pull FROM cd, gm WHERE step < {n * sweeps}))"""]


def _coefficient_query(name, penalty):
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, w[{i}] AS c FROM cd WHERE step = (SELECT max(step) FROM cd)" for i, f in enumerate(FEATURES, 1))
    sql = with_ctes(USER_DAYS, *_descent_sql(penalty), f"SELECT feature, CASE WHEN c < 0 THEN 'MIN' ELSE 'MAX' END AS direction, round(c, 6) + 0.0 AS coefficient FROM ({rows})")

    @query(name, sql.replace("WITH ", "WITH RECURSIVE ", 1))
    def coefficients(spark, sf):
        """From the moments of one aggregate over all rows; the table of coefficients has one row per feature."""
        found = penalised.penalised(bindings.user_days(spark, sf), "outcome", FEATURES, penalty)
        rows = [(f, "MIN" if c < 0 else "MAX", round(c, 6) + 0.0) for f, c in found.items()]
        return spark.createDataFrame(rows, "feature string, direction string, coefficient double")


_coefficient_query("d1_penalised_directions", 0.2)
_coefficient_query("d1_lightly_penalised_directions", 0.01)


@query("d2_normalised_features", with_ctes(USER_DAYS, NORM, f"SELECT user_pseudo_id, day, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)} FROM nm"))
def d2(spark, sf):
    n = _norm(spark, sf)
    return n.select("user_pseudo_id", "day", *[r(f, 6).alias(f) for f in FEATURES])


PAIR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS c FROM nm" for a in FEATURES for b in FEATURES if a != b)


@query("d3_redundancy_weights", with_ctes(USER_DAYS, NORM, f"pr AS ({PAIR_SQL})", "SELECT a AS feature, round(1 - avg(c) / 2 / 2, 6) AS weight FROM pr GROUP BY 1"))
def d3(spark, sf):
    n = _norm(spark, sf)
    weights = index_score.redundancy_weights(n, FEATURES)
    cells = [F.struct(F.lit(f).alias("feature"), r(F.lit(w), 6).alias("weight"), F.count("*").alias("_n")) for f, w in weights.items()]
    return n.agg(F.array(*cells).alias("_a")).select(F.inline("_a")).drop("_n")


@query("d4_index_score", with_ctes(*BASE, "SELECT user_pseudo_id, day, s AS composite_index, CASE WHEN s > m THEN 0 ELSE 1 END AS composite_index_label FROM sc, sm"))
def d4(spark, sf):
    return index_score.with_label(_scored(spark, sf), "composite_index", "composite_index_label").select("user_pseudo_id", "day", "composite_index", "composite_index_label")


@query("d5_category_indices", with_ctes(USER_DAYS, NORM, "SELECT user_pseudo_id, day, " + ", ".join(
    f"round({_dot({f: WEIGHTS[f] for f in fs})}, 6) AS index_{g}" for g, fs in GROUPS.items()) + " FROM nm"))
def d5(spark, sf):
    out = index_score.category_scores(_norm(spark, sf), WEIGHTS, GROUPS)
    return out.select("user_pseudo_id", "day", *[r(f"index_{g}", 6).alias(f"index_{g}") for g in GROUPS])


@query("d6_learned_weights")
def d6(spark, sf):
    n = index_score.with_label(_scored(spark, sf), "composite_index", "label").persist()
    views = index_score.learned_weights(n, "label", FEATURES)
    cells = [F.struct(F.lit(v).alias("view"), F.lit(f).alias("feature"), F.lit(float(w)).alias("weight"), F.count(f).alias("n")) for v, ws in views.items() for f, w in ws.items()]
    return n.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))


# Fixed view weights, so that pruning and blending can be checked by SQL.
VIEWS = {"a": [0.9, 0.0, 0.3, 0.2, 0.6, 0.1], "b": [0.0, 0.5, 0.4, 0.1, 0.3, 0.2], "c": [0.2, 0.4, 0.0, 0.5, 0.1, 0.3],
         "d": [0.3, 0.1, 0.2, 0.4, 0.0, 0.5], "e": [0.1, 0.3, 0.5, 0.2, 0.4, 0.0]}
VIEW_MAPS = {v: dict(zip(FEATURES, ws)) for v, ws in VIEWS.items()}
VIEW_SQL = "vw AS (SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{f}', {w}::DOUBLE)" for v, m in VIEW_MAPS.items() for f, w in m.items()) + ") AS t(view, feature, weight))"
MEANS_SQL = "fm AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg({f}) AS m FROM nm" for f in FEATURES) + ")"


def _views_frame(spark, sf):
    """The fixed view weights in long form, one row per view and feature."""
    cells = [F.struct(F.lit(v).alias("view"), F.lit(f).alias("feature"), F.lit(w).alias("weight"), F.count(f).alias("n"))
             for v, m in VIEW_MAPS.items() for f, w in m.items()]
    return _norm(spark, sf).agg(F.array(*cells).alias("_a")).select(F.inline("_a"))


@query("d7_pruned_weights", with_ctes(USER_DAYS, NORM, MEANS_SQL, VIEW_SQL, f"bm AS (SELECT avg({_dot(WEIGHTS)}) AS b FROM nm)", """
od AS (SELECT view, vw.feature, weight, m, row_number() OVER (PARTITION BY view ORDER BY weight DESC) AS i FROM vw JOIN fm USING (feature) WHERE weight <> 0),
cm AS (SELECT *, 100 * sum(weight * m) OVER (PARTITION BY view ORDER BY i) / i AS mean_i FROM od),
st AS (SELECT view, max(i) FILTER (mean_i NOT BETWEEN 0.9 * b AND 1.1 * b) AS k FROM cm, bm GROUP BY 1)""", """
SELECT vw.view, vw.feature, CASE WHEN od.i IS NOT NULL AND od.i <= coalesce(k, 0) THEN vw.weight ELSE 0 END AS weight FROM vw JOIN st ON st.view = vw.view LEFT JOIN od ON od.view = vw.view AND od.feature = vw.feature"""))
def d7(spark, sf):
    n = _norm(spark, sf).persist()
    means = index_score.feature_means(n, FEATURES)
    base = 100 * sum(WEIGHTS[f] * means[f] for f in FEATURES) / len(FEATURES)
    cells = [F.struct(F.lit(v).alias("view"), F.lit(f).alias("feature"), F.lit(float(w)).alias("weight"), F.count(f).alias("_n"))
             for v, m in VIEW_MAPS.items() for f, w in index_score.pruned_weights(m, means, base).items()]
    return n.agg(F.array(*cells).alias("_a")).select(F.inline("_a")).drop("_n")


BLEND_SQL = "bw AS (SELECT feature, sum(weight) * (1 + 0.1::DOUBLE * (greatest(count(*) FILTER (weight <> 0), 1) - 1)) / greatest(count(*) FILTER (weight <> 0), 1) AS w FROM vw GROUP BY 1)"


@query("d8_blended_score", with_ctes(USER_DAYS, NORM, VIEW_SQL, BLEND_SQL, "pv AS (SELECT " + ", ".join(f"max(w) FILTER (feature = '{f}') AS w_{f}" for f in FEATURES) + " FROM bw)",
      "SELECT user_pseudo_id, day, round((" + " + ".join(f"{f} * w_{f}" for f in FEATURES) + f") * 100 / {len(FEATURES)}, 6) AS composite_index FROM nm, pv"))
def d8(spark, sf):
    blend = index_score.blended_weights(list(VIEW_MAPS.values()))
    return _norm(spark, sf).select("user_pseudo_id", "day", r(index_score.score(blend), 6).alias("composite_index"))


@query("t4_top_weights", with_ctes(USER_DAYS, NORM, MEANS_SQL, VIEW_SQL, """
rk AS (SELECT view, feature, weight * m AS v, row_number() OVER (PARTITION BY view ORDER BY weight * m DESC, feature) AS i FROM vw JOIN fm USING (feature))""",
      "SELECT view, feature, round(v, 6) AS weight, CAST(i AS INTEGER) AS place FROM rk WHERE i <= 3"))
def t4(spark, sf):
    means = index_score.feature_means(_norm(spark, sf), FEATURES)
    exact = F.create_map(*[F.lit(x) for f, m in means.items() for x in (f, m)])
    frame = _views_frame(spark, sf).select("view", "feature", (F.col("weight") * exact[F.col("feature")]).alias("weight"))
    return index_score.top_weights(frame, 3).withColumn("weight", r("weight", 6))


@query("t5_consensus_features", with_ctes(USER_DAYS, NORM, MEANS_SQL, VIEW_SQL, """
rk AS (SELECT view, feature, row_number() OVER (PARTITION BY view ORDER BY weight * m DESC, feature) AS i FROM vw JOIN fm USING (feature)),
ct AS (SELECT feature, count(*) AS times FROM rk WHERE i <= 3 GROUP BY 1 HAVING count(*) > 1)""", "SELECT feature, times, round(1 + times / CAST((SELECT count(*) FROM ct) AS DOUBLE), 6) AS boost FROM ct"))
def t5(spark, sf):
    means = index_score.feature_means(_norm(spark, sf), FEATURES)
    exact = F.create_map(*[F.lit(x) for f, m in means.items() for x in (f, m)])
    frame = _views_frame(spark, sf).select("view", "feature", (F.col("weight") * exact[F.col("feature")]).alias("weight"))
    return index_score.consensus_features(frame, 3).withColumn("boost", r("boost", 6))


@query("d9_weight_sweep", with_ctes(USER_DAYS, NORM, """
sw AS (SELECT outcome, p AS percent, (""" + " + ".join(f"{f} * ({WEIGHTS[f]!r}::DOUBLE * (1 + p / 100.0::DOUBLE * ({b!r}::DOUBLE - 1)))" for f, b in {**dict.fromkeys(FEATURES, 1.0), "views": 1.5, "carts": 1.3}.items()) + f""") * 100 / {len(FEATURES)} AS s
  FROM nm, (SELECT unnest([0, 10, 20, 50])::INTEGER AS p)),
mn AS (SELECT percent, avg(s) AS m FROM sw GROUP BY 1)""", """
SELECT percent, round(m, 4) AS mean_score, count(*) FILTER (s >= m AND outcome = 1) AS good_above, count(*) FILTER (s >= m AND outcome <> 1) AS bad_above,
 count(*) FILTER (s < m AND outcome = 1) AS good_below, count(*) FILTER (s < m AND outcome <> 1) AS bad_below FROM sw JOIN mn USING (percent) GROUP BY 1, 2"""))
def d9(spark, sf):
    return index_score.weight_sweep(_norm(spark, sf), "outcome", WEIGHTS, {"views": 1.5, "carts": 1.3}, [0, 10, 20, 50]).withColumn("mean_score", r("mean_score", 4))


QUAD = "count(*) FILTER (s > m AND outcome = 1) AS good_above, count(*) FILTER (s > m AND outcome = 0) AS bad_above, count(*) FILTER (s < m AND outcome = 1) AS good_below, count(*) FILTER (s < m AND outcome = 0) AS bad_below"


@query("d10_quadrants", with_ctes(*BASE, f"q AS (SELECT m, count(*) AS n, max(s) AS hi, min(s) AS lo, {QUAD}, count(*) FILTER (outcome = 1) AS g, count(*) FILTER (outcome = 0) AS b FROM sc, sm GROUP BY m)", """
SELECT round(m, 6) AS mean_score, hi AS top_score, lo AS low_score, n AS n_rows, good_above, bad_above, good_below, bad_below, g AS good_total, b AS bad_total,
 round(good_above * 100.0::DOUBLE / (good_above + bad_above), 6) AS good_above_pct, round(good_below * 100.0::DOUBLE / (good_below + bad_below), 6) AS good_below_pct, round(g * 100.0::DOUBLE / n, 6) AS good_pct FROM q"""))
def d10(spark, sf):
    q = index_score.quadrants(_scored(spark, sf), "composite_index", "outcome")
    return q.withColumns({c: r(c, 6) for c in ("mean_score", "good_above_pct", "good_below_pct", "good_pct")})


@query("p6_quadrant_filter", with_ctes(*BASE, f"SELECT {QUAD} FROM sc, sm"))
def p6(spark, sf):
    return index_score.quadrants(_scored(spark, sf), "composite_index", "outcome").select("good_above", "bad_above", "good_below", "bad_below")


LINE = """ln AS (SELECT regr_slope(spend, s) AS a, regr_intercept(spend, s) AS b, regr_r2(spend, s) AS r2, avg(spend) AS y0, avg(s) AS x0, min(s) AS lo, max(s) AS hi FROM sc)"""


@query("d11_outcome_line", with_ctes(*BASE, LINE, """
SELECT round(a, 6) AS slope, round(b, 6) AS intercept, round(r2, 6) AS r2, CASE WHEN a < 0 THEN 'Negative' ELSE 'Positive' END AS direction, round(y0, 6) AS current_outcome,
 round(x0, 6) AS current_score, lo AS score_min, hi AS score_max FROM ln"""))
def d11(spark, sf):
    out = index_score.outcome_line(_scored(spark, sf), "composite_index", "spend")
    return out.withColumns({c: r(c, 6) for c in ("slope", "intercept", "r2", "current_outcome", "current_score")})


@query("d11_bin_curve", with_ctes(*BASE, """
qs AS (SELECT quantile_cont(s, [0.2, 0.4, 0.6, 0.8]) AS q FROM sc),
bn AS (SELECT s, outcome, (s > q[1])::INTEGER + (s > q[2])::INTEGER + (s > q[3])::INTEGER + (s > q[4])::INTEGER AS bin FROM sc, qs)""", """
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(s), 4) AS mean_score, round(avg(outcome) * 100, 4) AS outcome_rate FROM bn GROUP BY 1"""))
def d11b(spark, sf):
    out = index_score.bin_curve(_scored(spark, sf), "composite_index", "outcome")
    return out.withColumns({"mean_score": r("mean_score", 4), "outcome_rate": r("outcome_rate", 4)})


CELLS = clusters.CELLS
CLUSTERS = f"""
s6 AS (SELECT round(s, 6) AS s, outcome FROM sc), mm AS (SELECT min(s) AS lo, max(s) AS hi FROM s6),
ce AS (SELECT s, outcome, s - (lo + hi) / 2 AS d, least(CAST(floor((s - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * {CELLS}) AS INTEGER), {CELLS - 1}) AS cell FROM s6, mm),
fo AS (SELECT cell, CAST(count(*) AS DOUBLE) AS n, sum(d) AS s1, sum(d * d) AS s2 FROM ce GROUP BY 1),
pr AS (SELECT row_number() OVER w AS i, cell, sum(n) OVER w AS c, sum(s1) OVER w AS s, sum(s2) OVER w AS q FROM fo WINDOW w AS (ORDER BY cell)
       UNION ALL SELECT 0, -1, 0, 0, 0),
co AS (SELECT a.i AS b, e.i AS e, greatest(e.q - a.q - (e.s - a.s) * (e.s - a.s) / (e.c - a.c), 0) AS cost FROM pr a JOIN pr e ON a.i < e.i),
l1 AS (SELECT e, cost AS v FROM co WHERE b = 0),
""" + ",\n".join(f"l{k} AS (SELECT co.e, min(v + cost) AS v, arg_min(co.b, v + cost) AS b FROM l{k - 1} p JOIN co ON co.b = p.e GROUP BY 1)" for k in range(2, 6)) + """,
c4 AS (SELECT b AS i FROM l5 WHERE e = (SELECT max(i) FROM pr)), c3 AS (SELECT b AS i FROM l4 WHERE e = (SELECT i FROM c4)),
c2 AS (SELECT b AS i FROM l3 WHERE e = (SELECT i FROM c3)), c1 AS (SELECT b AS i FROM l2 WHERE e = (SELECT i FROM c2)),
cu AS (SELECT cell FROM pr WHERE i IN (SELECT i FROM c1 UNION SELECT i FROM c2 UNION SELECT i FROM c3 UNION SELECT i FROM c4))"""


@query("d11_cluster_curve", with_ctes(*BASE, CLUSTERS, """
SELECT CAST((SELECT count(*) FROM cu WHERE cu.cell < ce.cell) AS INTEGER) AS cluster, round(avg(s), 4) AS mean_score, round(avg(outcome) * 100, 4) AS outcome_rate, count(*) AS n FROM ce GROUP BY 1"""))
def d11c(spark, sf):
    scored = _scored(spark, sf).withColumn("s6", r("composite_index", 6))
    return index_score.cluster_curve(scored, "s6", "outcome").withColumns({"mean_score": r("mean_score", 4), "outcome_rate": r("outcome_rate", 4)})


@query("d12_improvement_targets", with_ctes(*BASE, LINE, """
g AS (SELECT a, x0, round(y0, 2) AS y, greatest(lo, 0) AS l, hi AS h FROM ln),
t AS (SELECT *, y * 1.1::DOUBLE AS imm, round(greatest(greatest(y + a * (l - x0), y + a * (h - x0)), 0), 2) AS best FROM g),
u AS (SELECT *, best + 0.25::DOUBLE * (imm - best) AS lng FROM t), v AS (SELECT *, (imm + lng) / 2 AS mid FROM u)""", """
SELECT round(x0, 2) AS current_score, y AS current_outcome, round(imm, 6) AS immediate_outcome, round(least(h, greatest(l, x0 + (imm - y) / a)), 2) AS immediate_score,
 round(mid, 6) AS midterm_outcome, round(least(h, greatest(l, x0 + (mid - y) / a)), 2) AS midterm_score, round(abs((y - mid) / y) * 100, 6) AS midterm_change_pct,
 round(lng, 6) AS longterm_outcome, round(least(h, greatest(l, x0 + (lng - y) / a)), 2) AS longterm_score, round(abs((y - lng) / y) * 100, 6) AS longterm_change_pct FROM v"""))
def d12(spark, sf):
    line = index_score.outcome_line(_scored(spark, sf), "composite_index", "spend")
    out = index_score.improvement_targets(line, index_score.Goal(10.0))
    return out.withColumns({c: r(c, 6) for c in out.columns if c.endswith(("m_outcome", "e_outcome", "change_pct")) and c != "current_outcome"})


@query("d12_curve_targets", with_ctes(*BASE, """
qs AS (SELECT quantile_cont(s, [0.2, 0.4, 0.6, 0.8]) AS q FROM sc),
bn AS (SELECT s, outcome, (s > q[1])::INTEGER + (s > q[2])::INTEGER + (s > q[3])::INTEGER + (s > q[4])::INTEGER AS bin FROM sc, qs),
cv AS (SELECT avg(s) AS x, avg(outcome) * 100 AS y FROM bn GROUP BY bin),
now_ AS (SELECT avg(s) AS x0, avg(outcome) * 100 AS y0 FROM sc),
goal AS (SELECT goal, up, x0, y0 * f AS want FROM now_, (VALUES ('immediate', true, 1.1::DOUBLE), ('lower', false, 0.9::DOUBLE), ('beyond', true, 9.0::DOUBLE)) g(goal, up, f)),
seg AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM cv a JOIN cv b ON b.x = (SELECT min(x) FROM cv c WHERE c.x > a.x)),
met AS (SELECT goal, CASE WHEN y1 = y2 THEN (x1 + x2) / 2 ELSE x1 + (want - y1) * (x2 - x1) / (y2 - y1) END AS x FROM goal JOIN seg ON want BETWEEN least(y1, y2) AND greatest(y1, y2)),
near_ AS (SELECT goal, x FROM goal JOIN cv ON true WHERE goal NOT IN (SELECT goal FROM met) QUALIFY row_number() OVER (PARTITION BY goal ORDER BY abs(y - want), x) = 1),
pick AS (SELECT o.goal, o.x FROM (SELECT * FROM met UNION ALL SELECT * FROM near_) o JOIN goal g ON o.goal = g.goal
 QUALIFY row_number() OVER (PARTITION BY o.goal ORDER BY o.x < 0, CASE WHEN up THEN o.x < x0 ELSE o.x > x0 END, abs(o.x - x0), o.x) = 1)""", """
SELECT goal, round(want, 4) AS wanted_outcome, round(least(greatest(x, 0, (SELECT min(x) FROM cv)), (SELECT max(x) FROM cv)), 2) AS score FROM pick JOIN goal USING (goal)"""))
def d12_curve(spark, sf):
    scored = _scored(spark, sf)
    curve = index_score.bin_curve(scored, "composite_index", "outcome")
    now = scored.agg(F.avg("composite_index").alias("current_score"), (F.avg("outcome") * 100).alias("_y"))
    goals = spark.createDataFrame([("immediate", True, 1.1), ("lower", False, 0.9), ("beyond", True, 9.0)], "goal string, score_up boolean, f double")
    wanted = scale.with_scalars(goals, now).select("goal", "score_up", "current_score", (F.col("_y") * F.col("f")).alias("wanted_outcome"))
    return index_score.curve_scores(curve, wanted).select("goal", r("wanted_outcome", 4).alias("wanted_outcome"), "score")


@query("d13_split_at_mean", with_ctes(USER_DAYS, "SELECT user_pseudo_id, day, CASE WHEN spend >= (SELECT avg(spend) FROM ud) THEN 0 ELSE 1 END AS spend_class FROM ud"))
def d13(spark, sf):
    return index_score.split_at_mean(bindings.user_days(spark, sf), "spend", "spend_class").select("user_pseudo_id", "day", "spend_class")


@query("d14_outcome_polarity")
def d14(spark, sf):
    from ..functions.naming import outcome_polarity

    choice = outcome_polarity("1", 1, 0, change="increasing")
    return bindings.user_days(spark, sf).groupBy("outcome").agg(F.count("*").alias("n")).withColumns({
        "is_target": (F.col("outcome") == choice.outcome).cast("int"), "score_moves_up": F.lit(int(choice.score_moves_up))})


CATS = {"behavior": ["views", "carts", "signups"], "value": ["other_value", "hours"], "quality": ["errors", "hours"]}
CAT_SQL = "ct AS (SELECT *, " + ", ".join(f"round({_dot({f: WEIGHTS[f] for f in fs})}, 6) AS s_{k}" for k, fs in CATS.items()) + " FROM nm)"


def _categories(spark, sf):
    n = _norm(spark, sf)
    return n.withColumns({f"index_{k}": r(index_score.score({f: WEIGHTS[f] for f in fs}), 6) for k, fs in CATS.items()})


@query("d15_category_run", with_ctes(USER_DAYS, NORM, CAT_SQL, " UNION ALL ".join(f"""
SELECT '{k}' AS category, {len(fs)} AS feature_count, count(*) AS row_count, round(avg(s_{k}), 6) AS current_score, round(corr(s_{k}, outcome), 4) AS target_correlation,
 round(regr_slope(spend, s_{k}), 4) AS slope FROM ct""" for k, fs in CATS.items())))
def d15(spark, sf):
    from ..plans.index_run import category_run

    out = category_run(_categories(spark, sf), {k: f"index_{k}" for k in CATS}, "outcome", "spend", {k: len(fs) for k, fs in CATS.items()}, index_score.Goal(10.0))
    return out.select("category", "feature_count", "row_count", r("current_score", 6).alias("current_score"), r("target_correlation", 4).alias("target_correlation"), r("slope", 4).alias("slope"))


def _traction_sql():
    parts = [f"""SELECT '{k}' AS category, m AS current_score, count(*) FILTER (s_{k} > m) AS high_users, count(*) FILTER (s_{k} > m AND outcome = 1) AS traction_users,
      count(*) FILTER (s_{k} > m AND outcome <> 1) AS friction_users, count(*) AS overall_users, count(*) FILTER (outcome = 1) AS buyer_count FROM ct, (SELECT avg(s_{k}) AS m FROM ct) GROUP BY m""" for k in CATS]
    return f"""se AS ({' UNION ALL '.join(parts)}),
tf AS (SELECT *, round(traction_users * 100.0::DOUBLE / high_users, 2) AS traction_pct, round(friction_users * 100.0::DOUBLE / high_users, 2) AS friction_pct FROM se),
nt AS (SELECT *, round(traction_pct - friction_pct, 2) AS net_traction FROM tf)"""


@query("d16_traction_friction", with_ctes(USER_DAYS, NORM, CAT_SQL, _traction_sql(), """
SELECT category, round(current_score, 6) AS current_score, high_users, traction_users, friction_users, overall_users, buyer_count, traction_pct, friction_pct, net_traction,
 CASE WHEN net_traction >= 20 THEN 'Strong Traction' WHEN net_traction >= 0 THEN 'Balanced' WHEN net_traction >= -20 THEN 'Friction Risk' ELSE 'High Friction' END AS status,
 CAST(row_number() OVER (ORDER BY traction_pct DESC, net_traction DESC, category) AS INTEGER) AS rank,
 CASE WHEN row_number() OVER (ORDER BY CASE WHEN high_users > 0 THEN 0 ELSE 1 END, net_traction, category) = 1 THEN 1 ELSE 0 END AS is_opportunity FROM nt"""))
def d16(spark, sf):
    return index_score.traction(_categories(spark, sf), {k: f"index_{k}" for k in CATS}, "outcome").withColumn("current_score", r("current_score", 6))


# A probability made from the score, so that evaluation can be checked by SQL.
PROB = "pb AS (SELECT *, round(least(1, greatest(0, s / 60)), 4) AS p FROM sc)"


def _prob(spark, sf):
    return _scored(spark, sf).withColumn("p", r(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("composite_index") / 60)), 4))


CONF = """count(*) AS n, count(*) FILTER (outcome = 1 AND h = 1) AS tp, count(*) FILTER (outcome <> 1 AND h = 1) AS fp, count(*) FILTER (outcome = 1 AND h <> 1) AS fn, count(*) FILTER (outcome <> 1 AND h <> 1) AS tn"""
GRID = [round(0.15 + i * 0.025, 4) for i in range(29)]
SEARCH = f"""
gr AS (SELECT DISTINCT unnest(list_concat([{', '.join(f'{g}::DOUBLE' for g in sorted({*GRID, 0.5}))}], [round(avg(outcome), 4)])) AS threshold FROM pb),
ts AS (SELECT threshold, {CONF} FROM (SELECT threshold, outcome, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS h FROM pb, gr) GROUP BY 1),
tm AS (SELECT *, (tp + tn) / CAST(n AS DOUBLE) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall,
  abs((tp + fp) / CAST(n AS DOUBLE) - (tp + fn) / CAST(n AS DOUBLE)) AS gap FROM ts)"""
AUC = """
rk AS (SELECT outcome, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE) AS rk FROM pb),
au AS (SELECT (sum(rk) FILTER (outcome = 1) - count(*) FILTER (outcome = 1) * (count(*) FILTER (outcome = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (outcome = 1) * CAST(count(*) FILTER (outcome <> 1) AS DOUBLE)) AS auc FROM rk)"""


@query("m2_threshold_search", with_ctes(*BASE, PROB, SEARCH, "SELECT threshold, n, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(gap, 6) AS calibration_gap FROM tm"))
def m2(spark, sf):
    s = evaluation.threshold_search(_prob(spark, sf), "outcome", "p")
    return s.select("threshold", "n", "tp", "fp", "fn", "tn", *[r(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "calibration_gap")])


@query("m2_best_threshold", with_ctes(*BASE, PROB, SEARCH, AUC, """
bs AS (SELECT *, round(0.45::DOUBLE * accuracy + 0.25::DOUBLE * precision + 0.2::DOUBLE * auc + 0.1::DOUBLE * recall - 0.05::DOUBLE * gap, 10) AS score FROM tm, au)""", """
SELECT threshold, round(score, 6) AS ranking_score, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(auc, 6) AS auc, round(gap, 6) AS calibration_gap FROM bs
ORDER BY score DESC, round(accuracy, 10) DESC, round(precision, 10) DESC, round(recall, 10) DESC, round(gap, 10), threshold LIMIT 1"""))
def m2b(spark, sf):
    p = _prob(spark, sf)
    best = evaluation.best_threshold(evaluation.threshold_search(p, "outcome", "p"), evaluation.auc(p, "outcome", "p"))
    return best.withColumns({c: r(c, 6) for c in best.columns if c != "threshold"})


@query("m3_confusion", with_ctes(*BASE, PROB, f"cf AS (SELECT {CONF} FROM (SELECT outcome, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS h FROM pb))", """
SELECT n, tp, fp, fn, tn, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy, CAST(CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / CAST(tp + fp AS DOUBLE), 6) END AS DOUBLE) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
 round(tn * 100.0::DOUBLE / (tn + fp), 6) AS class_0_correct_pct, round(tp * 100.0::DOUBLE / (tp + fn), 6) AS class_1_correct_pct FROM cf"""))
def m3(spark, sf):
    c = evaluation.confusion(_prob(spark, sf).withColumn("hat", (F.col("p") >= 0.5).cast("int")), "outcome", "hat")
    return c.withColumns({x: r(x, 6) for x in ("accuracy", "precision", "recall", "class_0_correct_pct", "class_1_correct_pct")})


@query("m4_auc", with_ctes(*BASE, PROB, AUC, "SELECT round(auc, 8) AS auc FROM au"))
def m4(spark, sf):
    return evaluation.auc(_prob(spark, sf), "outcome", "p").withColumn("auc", r("auc", 8))


@query("m4_roc_points", with_ctes(*BASE, PROB, """
g AS (SELECT p, count(*) FILTER (outcome = 1) AS pos, count(*) FILTER (outcome <> 1) AS neg FROM pb GROUP BY 1)""", """
SELECT p AS score, round(sum(neg) OVER (ORDER BY p DESC) / CAST(sum(neg) OVER () AS DOUBLE), 6) AS fpr, round(sum(pos) OVER (ORDER BY p DESC) / CAST(sum(pos) OVER () AS DOUBLE), 6) AS tpr, pos, neg FROM g"""))
def m4b(spark, sf):
    return evaluation.roc_points(_prob(spark, sf), "outcome", "p").withColumns({"fpr": r("fpr", 6), "tpr": r("tpr", 6)})


@query("m5_score_rule", with_ctes(*BASE, """
hb AS (SELECT avg(outcome) FILTER (s > m) AS h, avg(outcome) AS g, max(m) AS m FROM sc, sm),
ru AS (SELECT alpha, CASE WHEN g > h THEN 0 ELSE 1 END AS hl, alpha * m AS th FROM hb, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5])::DOUBLE AS alpha)),
pr AS (SELECT alpha, hl, th, outcome AS y, CASE WHEN s > th THEN hl ELSE 1 - hl END AS h FROM sc, ru)""", """
SELECT alpha, hl AS high_label, round(th, 6) AS threshold, count(*) AS n, count(*) FILTER (y = h) AS correct, count(*) FILTER (h = 1 AND y = 1) AS good_correct,
 count(*) FILTER (h = 0 AND y = 0) AS bad_correct, round(count(*) FILTER (y = h) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM pr GROUP BY 1, 2, 3"""))
def m5(spark, sf):
    out = evaluation.score_rule(_scored(spark, sf), "composite_index", "outcome")
    return out.withColumns({"threshold": r("threshold", 6), "accuracy": r("accuracy", 6)})


@query("m6_regression_metrics", with_ctes(*BASE, "pd AS (SELECT spend AS y, round(s * 3, 4) AS p FROM sc)", """
SELECT count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(avg(CASE WHEN y <> 0 THEN abs(y - p) / abs(y) END), 4) AS mape,
 round(avg(coalesce(2 * abs(y - p) / nullif(abs(y) + abs(p), 0), 0)), 4) AS smape, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2,
 round(avg(CASE WHEN abs(y - p) <= abs(y) * 0.1::DOUBLE THEN 1.0 ELSE 0 END), 6) AS within_10pct, round(avg(CASE WHEN y > 0 THEN CASE WHEN abs(y - p) <= y * 0.2::DOUBLE THEN 1.0 ELSE 0 END END), 6) AS within_20pct_positive,
 round(avg(CASE WHEN y = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0 END END), 6) AS zero_matched FROM pd"""))
def m6(spark, sf):
    s = _scored(spark, sf).withColumn("p", r(F.col("composite_index") * 3, 4))
    out = evaluation.regression_metrics(s, "spend", "p")
    return out.withColumns({c: r(c, 4) for c in ("mae", "mape", "smape", "r2")}).withColumns({c: r(c, 6) for c in ("within_10pct", "within_20pct_positive", "zero_matched")})


@query("m6_boosted_regression")
def m6b(spark, sf):
    from .clean import FEATURES as columns

    predicted = models.regression_predictions(bindings.user_days(spark, sf), "spend", columns, ["user_pseudo_id", "day"])
    return evaluation.regression_metrics(predicted, "actual", "predicted")


@query("m10_prediction_table", with_ctes(*BASE, PROB, """
SELECT user_pseudo_id, day, CASE WHEN outcome = 1 THEN 'buyer' ELSE 'visitor' END AS actual, CASE WHEN p >= 0.5 THEN 'buyer' ELSE 'visitor' END AS predicted,
 CASE WHEN (p >= 0.5) = (outcome = 1) THEN 1 ELSE 0 END AS hit FROM pb"""))
def m10(spark, sf):
    s = _prob(spark, sf).withColumn("hat", (F.col("p") >= 0.5).cast("int"))
    return evaluation.prediction_table(s, ["user_pseudo_id", "day"], "outcome", "hat", {1: "buyer", 0: "visitor"})


@query("m1_candidate_classifiers")
def m1(spark, sf):
    report, _ = models.compare_classifiers(bindings.user_days(spark, sf), "outcome", FEATURES, ["user_pseudo_id", "day"])
    return report


@query("m7_safe_logistic")
def m7(spark, sf):
    scored, _ = models.safe_logistic(bindings.user_days(spark, sf), "outcome", FEATURES, ["user_pseudo_id", "day"])
    return evaluation.confusion(scored, "y", "prediction")


@query("m8_leakage_names")
def m8(spark, sf):
    from ..functions.naming import audit_leakage

    ud = bindings.user_days(spark, sf).withColumns({"outcome_score": F.col("outcome") * 2, "order_count": F.col("views")})
    audit = audit_leakage(ud.columns, "outcome", "user_pseudo_id")
    cells = [F.struct(F.lit(c).alias("column"), F.count(c).alias("filled")) for c in audit.suspected]
    return ud.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))


def _importances(spark, sf):
    """Importances read from the data: the mean of every normalised feature, as percent."""
    n = _norm(spark, sf)
    cells = [F.struct(F.lit(f"feature_{i}").alias("feature"), r(F.avg(f) * 100, 4).alias("importance")) for i, f in enumerate(FEATURES)]
    return n.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))


IMP_SQL = "im AS (" + " UNION ALL ".join(f"SELECT 'feature_{i}' AS feature, round(avg({f}) * 100, 4) AS importance FROM nm" for i, f in enumerate(FEATURES)) + ")"
ENCODING = [("feature_0", "base_a", "red", 1), ("feature_1", "base_a", "blue", 2), ("feature_2", "base_b", "tall", 1)]
ENC_SQL = "en AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{b}', '{c}')" for e, b, c, _ in ENCODING) + ") AS t(feature, base, category))"


@query("e1_importance_by_base", with_ctes(USER_DAYS, NORM, IMP_SQL, ENC_SQL, """
j AS (SELECT im.feature, coalesce(base, im.feature) AS base, category, importance FROM im LEFT JOIN en USING (feature))""", """
SELECT base, round(sum(importance), 4) AS importance, coalesce(string_agg(category || ' -> ' || printf('%.2f', importance) || '%', '; ' ORDER BY importance DESC, category) FILTER (category IS NOT NULL), '') AS category_breakdown FROM j GROUP BY 1"""))
def e1(spark, sf):
    table = spark.createDataFrame(ENCODING, "encoded string, base string, category string, place int")
    return attribution.importance_by_base(_importances(spark, sf), table).withColumn("importance", r("importance", 4))


@query("e10_contribution_table", with_ctes(USER_DAYS, NORM, IMP_SQL, "tp5 AS (SELECT * FROM im ORDER BY importance DESC, feature LIMIT 5)", """
SELECT feature, importance, round(importance / sum(importance) OVER () * 100, 4) AS contribution_pct, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS place FROM tp5"""))
def e10(spark, sf):
    return attribution.contribution_table(_importances(spark, sf)).withColumn("contribution_pct", r("contribution_pct", 4))


@query("w11_cumulative_importance", with_ctes(USER_DAYS, NORM, IMP_SQL, """
c AS (SELECT feature, importance, sum(importance) OVER (ORDER BY importance DESC, feature) / sum(importance) OVER () AS cu, row_number() OVER (ORDER BY importance DESC, feature) AS i FROM im)""", """
SELECT feature, importance, round(cu, 6) AS cumulative, CAST(i AS INTEGER) AS place, CASE WHEN (SELECT count(*) FROM c WHERE cu <= 0.8) > 0 THEN CASE WHEN cu <= 0.8 THEN 1 ELSE 0 END WHEN i <= 10 THEN 1 ELSE 0 END AS selected FROM c"""))
def w11(spark, sf):
    return attribution.cumulative_importance(_importances(spark, sf)).withColumn("cumulative", r("cumulative", 6))


COEF = dict(zip(FEATURES, [0.4, 0.3, -0.2, -0.5, 0.1, 0.01]))


@query("e2_scenario", with_ctes(USER_DAYS, "SELECT user_pseudo_id, day, " + ", ".join(f"round({f} * {1.1 if c >= 0 else 0.9}::DOUBLE, 6) AS {f}" for f, c in COEF.items()) + " FROM ud"))
def e2(spark, sf):
    out = attribution.scenario(bindings.user_days(spark, sf), COEF, 10)
    return out.select("user_pseudo_id", "day", *[r(f, 6).alias(f) for f in FEATURES])


@query("e3_shift_weights", with_ctes(USER_DAYS, "sh AS (SELECT user_pseudo_id, day, " + " + ".join(f"abs({f} * {1.1 if c >= 0 else 0.9}::DOUBLE - {f})" for f, c in COEF.items()) + " AS h FROM ud)",
      "SELECT user_pseudo_id, day, round(1 + h / (SELECT max(h) FROM sh) * 1.75::DOUBLE, 6) AS row_weight FROM sh"))
def e3(spark, sf):
    ud = bindings.user_days(spark, sf)
    out = attribution.shift_weights(ud, attribution.scenario(ud, COEF, 10), ["user_pseudo_id", "day"], FEATURES, 1.75)
    return out.withColumn("row_weight", r("row_weight", 6))


@query("e3_class_weights", with_ctes(USER_DAYS, "c AS (SELECT outcome, count(*) AS n FROM ud GROUP BY 1)",
      "SELECT outcome, round((SELECT sum(n) FROM c) / CAST((SELECT count(*) FROM c) * n AS DOUBLE) * CASE WHEN outcome = 0 THEN 1.75 ELSE 1 END, 6) AS class_weight FROM c"))
def e3b(spark, sf):
    return attribution.class_weights(bindings.user_days(spark, sf), "outcome", bad=0).withColumn("class_weight", r("class_weight", 6))


def _tree(spark, sf):
    ud = bindings.user_days(spark, sf)
    weights = {f: 1.0 + i / 10 for i, f in enumerate(FEATURES)}
    model = models.weighted_tree(ud, "spend", FEATURES, weights, classification=False, depth=3)
    return ud, models.unscaled(attribution.tree_paths(model, FEATURES), weights)


@query("e4_weighted_tree")
def e4(spark, sf):
    ud, paths = _tree(spark, sf)
    return attribution.path_table(spark, paths)


FIXED_PATHS = [attribution.Path(0, (attribution.Condition("views", "<=", 0.5), attribution.Condition("errors", "<=", 0.5)), 10.0, 5),
               attribution.Path(1, (attribution.Condition("views", "<=", 0.5), attribution.Condition("errors", ">", 0.5)), 20.0, 5),
               attribution.Path(2, (attribution.Condition("views", ">", 0.5),), 30.0, 5)]


@query("e5_region_coverage", with_ctes(USER_DAYS, "lf AS (SELECT CASE WHEN views > 0.5 THEN 2 WHEN errors > 0.5 THEN 1 ELSE 0 END AS leaf, spend FROM ud)", """
SELECT leaf, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM ud) AS DOUBLE), 6) AS coverage, round(sum(CAST(round(spend * 100) AS BIGINT)) / (100.0::DOUBLE * count(*)), 6) AS mean_target, round(quantile_cont(spend, 0.1), 4) AS target_p10, round(quantile_cont(spend, 0.9), 4) AS target_p90 FROM lf GROUP BY 1"""))
def e5(spark, sf):
    # Whole cents add up exactly, so the mean does not depend on the order of the rows.
    ud = bindings.user_days(spark, sf).withColumn("cents", r(F.col("spend") * 100).cast("bigint"))
    out = attribution.region_coverage(ud, FIXED_PATHS, "cents")
    return out.withColumns({"coverage": r("coverage", 6), "mean_target": r(F.col("mean_target") / 100, 6), **{c: r(F.col(c) / 100, 4) for c in ("target_p10", "target_p90")}})


# Ways with repeated, contradicting and category conditions; thresholds are shares of what the data reach.
WAYS_TO_LEAVES = [(0, 1, "views", "<=", 0.9), (0, 2, "views", "<=", 0.5), (0, 3, "errors", ">", 0.1), (0, 4, "errors", ">", 0.2),
                  (1, 1, "views", ">", 0.5), (1, 2, "carts", "<=", 0.5), (1, 3, "carts", "<=", 0.25),
                  (2, 1, "hours", ">", 0.6), (2, 2, "hours", "<=", 0.3), (3, 1, "views", ">", 0.5), (4, 1, "device_a", ">", 0.0), (4, 2, "device_b", ">", 0.0),
                  (5, 1, "device_a", ">", 0.0), (5, 2, "device_a", "<=", 0.0), (6, 1, "device_b", "<=", 0.0), (6, 2, "views", ">", 0.1)]
REACH = ["views", "errors", "carts", "hours"]
DEVICES = {"device_a": "a", "device_b": "b"}


def _ways(spark, sf):
    """The conditions with thresholds, predictions and sample counts from the data."""
    ud = bindings.user_days(spark, sf)
    tops = ud.agg(*[F.max(c).alias(f"top_{c}") for c in REACH], F.count("*").alias("n"), F.sum(r(F.col("spend") * 100).cast("bigint")).alias("cents"))
    rows = spark.createDataFrame(WAYS_TO_LEAVES, "leaf int, step int, feature string, operator string, part double")
    top = F.coalesce(*[F.when(F.col("feature") == c, F.col(f"top_{c}")) for c in REACH], F.lit(1.0))
    return scale.with_scalars(rows, tops).select("leaf", "step", "feature", "operator", (F.col("part") * top).alias("threshold"),
                                                 (F.col("cents") % (F.col("leaf") + 7)).cast("double").alias("prediction"), (F.col("n") / (F.col("leaf") + 2)).alias("samples"))


def _devices(spark):
    return spark.createDataFrame([(f, "device", c) for f, c in DEVICES.items()], "feature string, base string, category string")


WAYS_SQL = "tp AS (SELECT count(*) AS n, sum(CAST(round(spend * 100) AS BIGINT)) AS cents, " + ", ".join(f"max({c}) AS top_{c}" for c in REACH) + " FROM ud), wy AS (" + " UNION ALL ".join(
    f"SELECT {leaf} AS leaf, '{f}' AS feature, '{o}' AS op, {p}::DOUBLE * {f'top_{f}' if f in REACH else '1'} AS thr, CAST(cents % {leaf + 7} AS DOUBLE) AS prediction, n / {leaf + 2}.0::DOUBLE AS samples FROM tp"
    for leaf, _, f, o, p in WAYS_TO_LEAVES) + ")"
TIDY_SQL = """
tidy AS (SELECT leaf, feature, 'upto' AS side, min(thr) AS thr, NULL AS cat FROM wy WHERE op = '<=' AND feature NOT LIKE 'device%' GROUP BY 1, 2
 UNION ALL SELECT leaf, feature, 'above', max(thr), NULL FROM wy WHERE op = '>' AND feature NOT LIKE 'device%' GROUP BY 1, 2
 UNION SELECT leaf, 'device', CASE op WHEN '>' THEN 'is' ELSE 'not' END, NULL, right(feature, 1) FROM wy WHERE feature LIKE 'device%'),
bad AS (SELECT l.leaf FROM tidy l JOIN tidy u ON l.leaf = u.leaf AND l.feature = u.feature AND l.side = 'above' AND u.side = 'upto' WHERE l.thr >= u.thr
 UNION SELECT leaf FROM tidy WHERE side = 'is' GROUP BY leaf HAVING count(*) > 1
 UNION SELECT x.leaf FROM tidy x JOIN tidy y ON x.leaf = y.leaf AND x.cat = y.cat AND x.side = 'is' AND y.side = 'not')"""


@query("e6_path_bounds", with_ctes(USER_DAYS, WAYS_SQL, TIDY_SQL, """
SELECT leaf, feature, CASE side WHEN 'upto' THEN '<=' WHEN 'above' THEN '>' WHEN 'is' THEN '=' ELSE '!=' END AS operator, round(thr, 6) AS threshold, cat AS category,
 leaf IN (SELECT leaf FROM bad) AS contradicts FROM tidy"""))
def e6_bounds(spark, sf):
    bounds = attribution.tightest_bounds(_ways(spark, sf), _devices(spark))
    wrong = attribution.contradictions(bounds).select("leaf").distinct().withColumn("hit", F.lit(True))
    return bounds.join(wrong, "leaf", "left").select("leaf", "feature", "operator", r("threshold", 6).alias("threshold"), "category", F.coalesce("hit", F.lit(False)).alias("contradicts"))


@query("e6_region_scores", with_ctes(USER_DAYS, WAYS_SQL, TIDY_SQL, """
us AS (SELECT leaf, feature, count(*) AS k FROM wy GROUP BY 1, 2)""", """
SELECT leaf, round(any_value(prediction) + least(any_value(samples) / (SELECT n FROM tp), 0.25) * 4
 + 0.35 * (SELECT count(DISTINCT feature) FROM tidy t WHERE t.leaf = wy.leaf AND feature IN ('views', 'errors', 'hours'))
 - 0.15 * (count(*) - count(DISTINCT feature)) - greatest((SELECT max(k) FROM us WHERE us.leaf = wy.leaf) / CAST(count(*) AS DOUBLE) - 0.6, 0)
 - CASE WHEN leaf IN (SELECT leaf FROM bad) THEN 2 ELSE 0 END - CASE WHEN (SELECT count(*) FROM tidy t WHERE t.leaf = wy.leaf) < 2 THEN 0.5 ELSE 0 END, 6) AS region_score
FROM wy GROUP BY leaf"""))
def e6_scores(spark, sf):
    ways = _ways(spark, sf)
    total = bindings.user_days(spark, sf).count()
    return attribution.region_scores(ways, total, ["views", "errors", "hours", "carts"], encoding=_devices(spark)).select("leaf", r("region_score", 6).alias("region_score"))


@query("e6_region_choice")
def e6(spark, sf):
    ud, paths = _tree(spark, sf)
    ends = attribution.extreme_leaves(attribution.path_table(spark, paths))
    cover = attribution.region_coverage(ud, paths, "spend")
    return cover.join(F.broadcast(ends), F.col("leaf").isin(F.col("low"), F.col("high"))) \
        .select(*cover.columns, F.when(F.col("leaf") == F.col("high"), "high").otherwise("low").alias("side"), "similarity")


@query("e7_path_costs")
def e7(spark, sf):
    ud, paths = _tree(spark, sf)
    costs = attribution.path_costs(paths, {f: 0.1 * (i + 1) for i, f in enumerate(FEATURES)})
    rows = spark.createDataFrame([(p.leaf, float(c), float(s), i + 1) for i, (p, c, s) in enumerate(costs)], "leaf int, cost double, weight_sum double, place int")
    return rows.join(F.broadcast(attribution.region_coverage(ud, paths, "spend")), "leaf", "left")


RULE_CASES = [("a", "views", "higher"), ("a", "views", "lower"), ("a", "errors", "lower"), ("a", "carts", "higher"), ("a", "hours", "higher"), ("b", "views", "lower"), ("b", "errors", "higher"), ("b", "carts", "higher")]


def _rules(spark, sf):
    """Rules with sample counts from the data: rows on the given side of one half."""
    side = {"higher": lambda f: F.col(f) > 0.5, "lower": lambda f: F.col(f) <= 0.5}
    who = {"a": 1, "b": 0}
    cells = [F.struct(F.lit(c).alias("class"), F.lit(f).alias("feature"), F.lit(d).alias("direction"),
                      F.count_if(side[d](f) & (F.col("outcome") == who[c])).alias("samples"), F.lit(2).alias("depth"), F.lit(0.5).alias("purity"),
                      F.lit(0.0).alias("impurity_reduction")) for c, f, d in RULE_CASES]
    return bindings.user_days(spark, sf).agg(F.array(*cells).alias("_a")).select(F.inline("_a"))


RULE_SQL = "ru AS (" + " UNION ALL ".join(f"SELECT '{c}' AS class, '{f}' AS feature, '{d}' AS direction, count(*) FILTER ({f} {'>' if d == 'higher' else '<='} 0.5 AND outcome = {1 if c == 'a' else 0}) AS samples FROM ud" for c, f, d in RULE_CASES) + ")"


@query("e8_ranked_rules", with_ctes(USER_DAYS, RULE_SQL, """
s AS (SELECT *, samples * 0.6::DOUBLE + 0.4::DOUBLE + 0.1::DOUBLE AS score FROM ru),
k1 AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY class, feature ORDER BY score DESC, direction) = 1),
k2 AS (SELECT * FROM k1 QUALIFY row_number() OVER (PARTITION BY class ORDER BY score DESC, feature) <= 3),
k3 AS (SELECT * FROM k2 QUALIFY row_number() OVER (PARTITION BY feature, direction ORDER BY score DESC, class) = 1)""", """
SELECT class, feature, direction, samples, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY class ORDER BY score DESC, feature) AS INTEGER) AS rank FROM k3"""))
def e8(spark, sf):
    return attribution.ranked_rules(_rules(spark, sf)).select("class", "feature", "direction", "samples", r("score", 6).alias("score"), "rank")


ATTR = "atr AS (SELECT user_pseudo_id, day, p, " + ", ".join(f"{c!r}::DOUBLE * ({f} - m_{f}) * p * (1 - p) AS a_{f}" for f, c in COEF.items()) + " FROM (SELECT *, 1 / (1 + exp(-(-0.5::DOUBLE + " + " + ".join(
    f"{f} * {c!r}::DOUBLE" for f, c in COEF.items()) + "))) AS p FROM ud), (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in FEATURES) + " FROM ud))"


@query("e9_linear_attributions", with_ctes(USER_DAYS, ATTR, "SELECT user_pseudo_id, day, round(p, 6) AS probability, " + ", ".join(f"round(a_{f}, 6) + 0.0 AS attr_{f}" for f in FEATURES) + " FROM atr"))
def e9(spark, sf):
    out = attribution.linear_attributions(bindings.user_days(spark, sf), COEF, -0.5, ["user_pseudo_id", "day"])
    return out.select("user_pseudo_id", "day", r("probability", 6).alias("probability"), *[(r(f"attr_{f}", 6) + 0.0).alias(f"attr_{f}") for f in FEATURES])


@query("e9_global_attributions", with_ctes(USER_DAYS, ATTR, "g AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(a_{f}) AS m FROM atr" for f in FEATURES) + ")",
      "SELECT feature, round(m, 6) AS mean_attribution, CAST(row_number() OVER (ORDER BY abs(m) DESC, feature) AS INTEGER) AS place FROM g"))
def e9b(spark, sf):
    local = attribution.linear_attributions(bindings.user_days(spark, sf), COEF, -0.5, ["user_pseudo_id", "day"])
    return attribution.global_attributions(local).withColumn("mean_attribution", r("mean_attribution", 6))


@query("z2_outcome_rate_by_score", with_ctes(*BASE, "SELECT CAST(floor(least(9, greatest(0, s / 10))) AS INTEGER) AS decile, count(*) AS n, round(avg(outcome), 6) AS rate FROM sc GROUP BY 1"))
def z2(spark, sf):
    from ..functions.scalars import clip

    s = _scored(spark, sf).withColumn("decile", F.floor(clip(F.col("composite_index") / 10, 0.0, 9.0)).cast("int"))
    return s.groupBy("decile").agg(F.count("*").alias("n"), r(F.avg("outcome"), 6).alias("rate"))
