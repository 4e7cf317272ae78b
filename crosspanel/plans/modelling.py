"""Queries for the walk-forward, member combination and attribution operators."""

import numpy as np
from pyspark.sql import functions as F

from crosspanel.functions import ts, xs
from crosspanel.operators import boosting, ensemble, factors, walkforward
from crosspanel.plans import factors as factor_plans
from crosspanel.plans import portfolio as portfolio_plans
from crosspanel.plans import profiling as profiling_plans
from crosspanel.plans.registry import query
from crosspanel.plans.sql import view
from crosspanel.sources import store

MODELS = portfolio_plans.MODELS
TRAIN, VAL, RETRAIN = 104, 26, 12


def plan_sql(first: str, source: str = "scores", train: int = TRAIN, val: int = VAL, retrain: int = RETRAIN, purge: int = 0) -> str:
    return f"""WITH idx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM {source})),
      r AS (SELECT *, (i - {train + val}) // {retrain} AS retrain_id FROM idx WHERE i >= {train + val} AND (i - {train + val}) % {retrain} = 0)
      SELECT retrain_id, r.date AS retrain_date, a.date AS train_from, b.date AS train_to, c.date AS val_from, d.date AS val_to,
        r.date AS score_from, f.date AS score_to FROM r JOIN idx a ON a.i = {first} JOIN idx b ON b.i = r.i - {val + 1 + purge}
        JOIN idx c ON c.i = r.i - {val} JOIN idx d ON d.i = r.i - {1 + purge} JOIN idx f ON f.i = least(r.i + {retrain - 1}, r.n - 1)"""


view("plan", "scores", plan_sql(f"r.i - {TRAIN + VAL}"))
PLAN = "retrain_id:i retrain_date:d train_from:d train_to:d val_from:d val_to:d score_from:d score_to:d"


def plan(t, **kw):
    return walkforward.schedule(portfolio_plans.staged_scores(t), TRAIN, VAL, RETRAIN, **kw)


@query("h1_schedule_rolling", PLAN, "SELECT * FROM plan", "plan")
def schedule_rolling(t):
    return plan(t)


@query("h1_schedule_expanding", PLAN, plan_sql("0"), "scores")
def schedule_expanding(t):
    return plan(t, window="expanding")


@query("h1_schedule_capped", PLAN, plan_sql(f"greatest(r.i - {VAL + 156}, 0)"), "scores")
def schedule_capped(t):
    return plan(t, window="expanding", max_train=156)


FEATURES = profiling_plans.COLS


@query(
    "h1_schedule_purged", PLAN, plan_sql(f"r.i - {TRAIN + VAL}", purge=2), "scores",
)
def schedule_purged(t):
    return plan(t, purge_weeks=2)


@query(
    "h2_fold_assembly", "date:d symbol target:6 " + " ".join(f"{c}:5" for c in FEATURES),
    "SELECT date, symbol, target, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURES)
    + " FROM four JOIN target USING (date, symbol) WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'",
    "four target",
)
def fold_assembly(t):
    return fold_between(t, "1997-01-01", "1998-06-30")


def fold_between(t, first, last):
    day = lambda s: F.lit(s).cast("date")
    return walkforward.assemble_fold(
        profiling_plans.four(t), profiling_plans.target(t), FEATURES, day(first), day(last)
    )


# -- trained members: results depend on the learner, so these have no SQL ---------------

BIG_TRAIN, BIG_VAL, BIG_RETRAIN = 208, 52, 49
view("big_plan", "four", plan_sql(f"r.i - {BIG_TRAIN + BIG_VAL}", "four", BIG_TRAIN, BIG_VAL, BIG_RETRAIN))
QUICK_GBT = {"maxIter": 24, "patience": 4, "maxDepth": 3, "stepSize": 0.1, "maxBins": 16}
QUICK_FOREST = {"numTrees": 10, "maxDepth": 4, "maxBins": 16}


def model_inputs(t):
    """Z-scored factors and the target."""
    z = xs.zscore(xs.winsorize(profiling_plans.four(t), FEATURES, max_group=t.n_symbols), FEATURES, max_group=t.n_symbols)
    return z, profiling_plans.target(t)


def trained(t, members):
    big = walkforward.schedule(profiling_plans.four(t), BIG_TRAIN, BIG_VAL, BIG_RETRAIN)
    return walkforward.walk_forward(*model_inputs(t), FEATURES, big, members, t.n_symbols)


def gbt_member(fold):
    return walkforward.boosted(fold, **QUICK_GBT)


def forest_member(fold):
    # The forest has no early stopping and trains on the validation rows too.
    return walkforward.forest(**QUICK_FOREST).fit(fold)


@query("h3_gradient_boosting", "date:d symbol prediction:6")
def gradient_boosting(t):
    return trained(t, {"gbt": gbt_member})[0]


@query("h4_random_forest", "date:d symbol prediction:6")
def random_forest(t):
    return trained(t, {"forest": forest_member})[0]


QUICK_LEAFWISE = {"rounds": 1, "rate": 0.1, "patience": 1}


@query("h3_leafwise_boosting", "date:d symbol prediction:6")
def leafwise_boosting(t):
    """The second boosting member: 31 leaves, best leaf first."""
    return trained(t, {"leafwise": walkforward.leafwise(FEATURES, **QUICK_LEAFWISE)})[0]


EDGES = np.linspace(-0.2, 0.2, 17).tolist()
FOLD_FROM, FOLD_TO = "1995-01-01", "1998-06-30"
view(
    "first_cells", "four target",
    f"""WITH fold AS (SELECT *, target - avg(target) OVER () AS g FROM four JOIN target USING (date, symbol)
          WHERE date BETWEEN DATE '{FOLD_FROM}' AND DATE '{FOLD_TO}')
        SELECT feature, bin, count(*) AS n, sum(g) AS g FROM ("""
    + " UNION ALL ".join(
        f"SELECT {i} AS feature, len(list_filter({EDGES}::DOUBLE[], lambda e: e <= coalesce({c}, 0))) AS bin, g FROM fold"
        for i, c in enumerate(FEATURES))
    + ") GROUP BY 1, 2",
)


def first_cells(t):
    """The first tree's histogram over the rows of a fold."""
    fold = fold_between(t, FOLD_FROM, FOLD_TO).withColumn("is_val", F.lit(False))
    return t.staged("first cells", lambda: boosting.first_histogram(fold, FEATURES, [EDGES] * len(FEATURES)))


@query("h3_first_histogram", "feature:i bin:i n:i g:5", "SELECT * FROM first_cells", "first_cells")
def first_histogram(t):
    return first_cells(t)


@query(
    "h3_first_split", "feature:i bin:i gain:4 left_n:i n:i left_g:5",
    """SELECT feature, bin, gain, left_n, n, left_g FROM (
         SELECT *, left_g * left_g / (left_n + 2.0) + (g - left_g) * (g - left_g) / (n - left_n + 2.0) - g * g / (n + 2.0) AS gain FROM (
           SELECT feature, bin, sum(n) OVER u AS left_n, sum(g) OVER u AS left_g, sum(n) OVER f AS n, sum(g) OVER f AS g FROM first_cells
           WINDOW f AS (PARTITION BY feature), u AS (PARTITION BY feature ORDER BY bin))
         WHERE left_n >= 20 AND n - left_n >= 20) ORDER BY gain DESC, feature, bin LIMIT 1""",
    "first_cells",
)
def first_split(t):
    return boosting.best_splits(first_cells(t), F.lit(2.0), F.lit(20))


@query("h5_random_parameter_bag", "date:d symbol prediction:6")
def parameter_bag(t):
    """The whole bag: 200 candidates, each up to its best of 2,000 rounds, the best 50 by rank-IC kept."""
    return trained(t, {"bag": walkforward.leafwise_bag(FEATURES, max_group=t.n_symbols)})[0]


def stored_trees():
    """A booster of two small trees, as a run would load it."""
    first, second = boosting.Tree(), boosting.Tree()
    left = first.split(0, 0, 0, 3.0)  # R1W < 0
    inner = first.split(left, 1, 1, 1.0)  # R1M < 0.05
    first.value[inner], first.value[inner + 1], first.value[left + 1] = 0.25, -0.5, 0.125
    left = second.split(0, 3, 0, 1.0)  # VOL6M < 0.3
    second.value[left], second.value[left + 1] = 0.03125, -0.0625
    return boosting.Booster(FEATURES, [np.array(e) for e in ([0.0], [-0.05, 0.05], [], [0.3])], 0.5, [first, second], [])


@query(
    "h6_stored_trees", "date:d symbol prediction:6",
    """SELECT date, symbol, 0.5 + CASE WHEN coalesce(R1W, 0) < 0 THEN CASE WHEN coalesce(R1M, 0) < 0.05::DOUBLE THEN 0.25 ELSE -0.5 END ELSE 0.125 END
         + CASE WHEN coalesce(VOL6M, 0) < 0.3::DOUBLE THEN 0.03125 ELSE -0.0625 END AS prediction FROM four""",
    "four",
)
def scored_by_stored_trees(t):
    return walkforward.score(stored_trees(), profiling_plans.four(t))


@query(
    "h4_fold_rows", "retrain_id:i train_rows:i val_rows:i target:4",
    """SELECT retrain_id, count(*) FILTER (WHERE date <= train_to) AS train_rows, count(*) FILTER (WHERE date >= val_from) AS val_rows,
         sum(target) AS target FROM four JOIN target USING (date, symbol) JOIN big_plan ON date BETWEEN train_from AND val_to GROUP BY 1""",
    "four target big_plan",
)
def fold_rows(t):
    """What a retrain's fold holds: the forest learns from both parts, boosting stops on the second."""
    df = profiling_plans.four(t)
    weeks = walkforward.weeks_in(
        walkforward.schedule(df, BIG_TRAIN, BIG_VAL, BIG_RETRAIN), "train_from", "val_to")
    rows = df.join(profiling_plans.target(t), ["date", "symbol"]).join(F.broadcast(weeks), "date")
    return rows.groupBy("retrain_id").agg(
        F.count_if(F.col("date") <= F.col("train_to")).alias("train_rows"),
        F.count_if(F.col("date") >= F.col("val_from")).alias("val_rows"), F.sum("target").alias("target"))


@query("h6_weekly_scoring", "date:d symbol model prediction:6")
def weekly_scoring(t):
    return trained(t, {"gbt": gbt_member, "forest": forest_member})[0]


BOTH = {"gbt": gbt_member, "forest": forest_member}


@query(
    "h6_scored_rows", "retrain_id:i model date:d n:i symbols:i",
    """SELECT retrain_id, model, date, count(*) AS n, sum(symbol) AS symbols FROM four
       JOIN big_plan p ON date BETWEEN score_from AND score_to CROSS JOIN (VALUES ('gbt'), ('forest')) v(model) GROUP BY 1, 2, 3""",
    "four big_plan",
)
def scored_rows(t):
    """Which retrain and model scored which names in each week."""
    return trained(t, BOTH)[0].filter("prediction is not null").groupBy("retrain_id", "model", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("symbol").alias("symbols"))


@query(
    "h17_importance_totals", "retrain_id:i model features:i total:4",
    """SELECT retrain_id, model, 4 AS features, 1.0 AS total FROM big_plan CROSS JOIN (VALUES ('gbt'), ('forest')) v(model)""",
    "big_plan",
)
def importance_totals(t):
    """Importances of every fit: one per feature, adding up to 1."""
    return trained(t, BOTH)[2].groupBy("retrain_id", "model").agg(
        F.count_distinct("feature").alias("features"), F.sum("importance").alias("total"))


@query("h12_live_week", "date:d symbol prediction:6")
def live_week(t):
    preds = trained(t, {"gbt": gbt_member, "forest": forest_member})[0]
    last = preds.agg(F.max("date")).scalar()
    return ensemble.score_week(preds.filter(F.col("date") == last), "stack", t.n_symbols)


@query("h17_feature_importance", "retrain_id:i model feature importance:6")
def feature_importance(t):
    return trained(t, {"gbt": gbt_member, "forest": forest_member})[2]


@query("h17_permutation_importance", "feature delta_ic:6")
def permutation_importance(t):
    z, y = model_inputs(t)
    fold = z.na.fill(0.0).join(y, ["date", "symbol"])
    fold = t.staged("fold", lambda: fold.withColumn("is_val", F.col("date") >= F.lit("2000-06-01").cast("date")))
    model = gbt_member(walkforward._vector(FEATURES).transform(fold))
    out = walkforward.permutation_importance(model, fold.filter("is_val"), FEATURES, max_group=t.n_symbols)
    return t.spark.createDataFrame(out, "feature string, delta_ic double")


def linear_score(rows):
    """A fixed score, so that what the permutation does can be checked apart from a learner."""
    return rows.select("date", "symbol", "target", (F.col("R1M") * 0.75 - F.col("R1W") * 0.5).alias("prediction"))


def md5_of_symbol(seed):
    text = F.concat(F.col("symbol").cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


@query(
    "h17_permutation_of_fixed_score", "feature delta_ic:6",
    """WITH rows_ AS (SELECT date, symbol, target, coalesce(R1W, 0) AS a, coalesce(R1M, 0) AS b, md5(symbol || ':7') AS h0, md5(symbol || ':8') AS h1
             FROM four JOIN target USING (date, symbol)),
       k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY substr(h0, 1, 8), symbol) AS p0,
               row_number() OVER (PARTITION BY date ORDER BY substr(h1, 1, 8), symbol) AS p1 FROM rows_),
       moved AS (SELECT x.date, x.symbol, x.target, x.a, x.b, y.a AS a2, y.b AS b2 FROM k x JOIN k y ON y.date = x.date AND y.p1 = x.p0),
       s AS (SELECT 'base' AS feature, date, target, b * 0.75 - a * 0.5 AS v FROM moved UNION ALL SELECT 'R1W', date, target, b * 0.75 - a2 * 0.5 FROM moved
             UNION ALL SELECT 'R1M', date, target, b2 * 0.75 - a * 0.5 FROM moved),
       r AS (SELECT feature, date, rank() OVER (PARTITION BY feature, date ORDER BY v) + (count(*) OVER (PARTITION BY feature, date, v) - 1) / 2.0 AS rp,
               rank() OVER (PARTITION BY feature, date ORDER BY target) + (count(*) OVER (PARTITION BY feature, date, target) - 1) / 2.0 AS ra FROM s),
       ic AS (SELECT feature, date, CASE WHEN count(*) >= 5 AND stddev_samp(rp) > 0 AND stddev_samp(ra) > 0 THEN corr(rp, ra) END AS ic FROM r GROUP BY 1, 2),
       q AS (SELECT feature, avg(ic) AS ic FROM ic GROUP BY 1)
       SELECT q.feature, base.ic - q.ic AS delta_ic FROM q, (SELECT ic FROM q WHERE feature = 'base') base WHERE q.feature <> 'base'""",
    "four target",
)
def permutation_of_fixed_score(t):
    fold = walkforward.assemble_fold(
        profiling_plans.four(t), profiling_plans.target(t), FEATURES, F.lit("1900-01-01").cast("date"), F.lit("2100-01-01").cast("date"))
    out = walkforward.importances(linear_score, fold, ["R1W", "R1M"], max_group=t.n_symbols, order=md5_of_symbol)
    return t.spark.createDataFrame(out, "feature string, delta_ic double")


# -- rank-IC and combiners over the three simple score sets -------------------------------


def members(t):
    return t.staged("members", lambda: portfolio_plans.model_scores(t))


def actual(t):
    return t.staged("target", lambda: profiling_plans.target(t))


AVG_RANK = "rank() OVER (PARTITION BY model, date ORDER BY {c}) + (count(*) OVER (PARTITION BY model, date, {c}) - 1) / 2.0"
view(
    "ic", "models target",
    f"""SELECT model, date, CASE WHEN count(*) >= 5 THEN corr(rp, ra) END AS ic FROM (
          SELECT model, date, {AVG_RANK.format(c='prediction')} AS rp, {AVG_RANK.format(c='target')} AS ra
          FROM models JOIN target USING (date, symbol)) GROUP BY 1, 2""",
)


def ic(t):
    rows = members(t).join(actual(t), ["date", "symbol"])
    return ensemble.rank_ic(rows, "prediction", "target", ["model"], max_group=t.n_symbols)


@query("h7_rank_ic_by_date", "model date:d ic:6", "SELECT * FROM ic", "ic")
def rank_ic_by_date(t):
    return ic(t)


@query("h7_mean_rank_ic", "model ic:6", "SELECT model, avg(ic) AS ic FROM ic GROUP BY 1", "ic")
def mean_rank_ic(t):
    return ensemble.mean_rank_ic(ic(t), ["model"])


@query("h8_combine_mean", "date:d symbol prediction:4",
       "SELECT date, symbol, avg(prediction) AS prediction FROM models GROUP BY 1, 2", "models")
def combine_mean(t):
    return ensemble.combine("mean", members(t))


view(
    "mranks", "models",
    f"SELECT date, symbol, model, ({AVG_RANK.format(c='prediction')}) / count(*) OVER (PARTITION BY model, date) AS pct FROM models",
)


@query("h9_combine_rank_mean", "date:d symbol prediction:7",
       "SELECT date, symbol, avg(pct) AS prediction FROM mranks GROUP BY 1, 2", "mranks")
def combine_rank_mean(t):
    return ensemble.combine("rank_mean", members(t), max_group=t.n_symbols)


@query(
    "h12_live_rank_mean", "date:d symbol prediction:7",
    "SELECT date, symbol, avg(pct) AS prediction FROM mranks WHERE date = (SELECT max(date) FROM mranks) GROUP BY 1, 2", "mranks",
)
def live_rank_mean(t):
    """A live week has no history of its own to stack on, so the stack falls back to the rank mean."""
    preds = members(t)
    last = preds.agg(F.max("date")).scalar()
    return ensemble.score_week(preds.filter(F.col("date") == last), "stack", t.n_symbols)


def validation_ic(t):
    """Each member's mean rank-IC over a retrain's validation weeks, per scored week."""
    p = plan(t)
    by_date = ic(t)
    val = by_date.join(walkforward.weeks_in(p, "val_from", "val_to"), "date")
    per = val.groupBy("retrain_id", "model").agg(F.avg("ic").alias("val_ic"))
    scored = walkforward.weeks_in(p, "score_from", "score_to")
    return scored.select("date", "retrain_id").join(per, "retrain_id").select("date", "model", "val_ic")


@query(
    "h10_combine_ic_weighted", "date:d symbol prediction:7",
    """WITH per AS (SELECT retrain_id, model, avg(ic) AS v FROM ic JOIN plan ON date BETWEEN val_from AND val_to GROUP BY 1, 2),
       w AS (SELECT d.date, model, CASE WHEN sum(greatest(v, 0)) OVER (PARTITION BY d.date) > 0
           THEN greatest(v, 0) / sum(greatest(v, 0)) OVER (PARTITION BY d.date) ELSE 1.0 / 3 END AS w
         FROM (SELECT DISTINCT date FROM scores) d JOIN plan ON d.date BETWEEN score_from AND score_to JOIN per USING (retrain_id))
       SELECT date, symbol, sum(pct * coalesce(w, 1.0 / 3)) AS prediction FROM mranks LEFT JOIN w USING (date, model) GROUP BY 1, 2""",
    "ic plan mranks scores",
)
def combine_ic_weighted(t):
    return ensemble.combine(
        "ir_weighted", members(t), val_ic=validation_ic(t), members=MODELS, max_group=t.n_symbols
    )


P = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(
    "h11_combine_stack", "date:d symbol prediction:5",
    f"""WITH r AS (SELECT date, symbol, max(pct) FILTER (WHERE model = 'reversal') AS a, max(pct) FILTER (WHERE model = 'trend') AS b,
           max(pct) FILTER (WHERE model = 'cheap') AS c FROM mranks GROUP BY 1, 2),
       k AS (SELECT r.*, t.target AS y FROM r JOIN target t USING (date, symbol) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
       wk AS (SELECT d.date, row_number() OVER (ORDER BY d.date) - 1 AS week, n, sa, sb, sc, sy, saa, sab, sac, sbb, sbc, scc, say, sby, scy
         FROM (SELECT DISTINCT date FROM r) d LEFT JOIN (SELECT date, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc, sum(y) AS sy,
           sum(a*a) AS saa, sum(a*b) AS sab, sum(a*c) AS sac, sum(b*b) AS sbb, sum(b*c) AS sbc, sum(c*c) AS scc, sum(a*y) AS say,
           sum(b*y) AS sby, sum(c*y) AS scy FROM k GROUP BY date) USING (date)),
       run AS (SELECT date, week, """
    + ", ".join(f"sum({c}) OVER (ORDER BY date {P}) AS {c}" for c in "n sa sb sc sy saa sab sac sbb sbc scc say sby scy".split())
    + """ FROM wk),
       m AS (SELECT date, week, n, sa/n AS ma, sb/n AS mb, sc/n AS mc, saa - sa*sa/n + 1 AS p, sab - sa*sb/n AS q, sac - sa*sc/n AS s,
           sbb - sb*sb/n + 1 AS u, sbc - sb*sc/n AS v, scc - sc*sc/n + 1 AS w, say - sa*sy/n AS f, sby - sb*sy/n AS g, scy - sc*sy/n AS h FROM run),
       beta AS (SELECT *, p*(u*w - v*v) - q*(q*w - v*s) + s*(q*v - u*s) AS det, f*(u*w - v*v) - q*(g*w - v*h) + s*(g*v - u*h) AS d1,
           p*(g*w - v*h) - f*(q*w - v*s) + s*(q*h - g*s) AS d2, p*(u*h - g*v) - q*(q*h - g*s) + f*(q*v - u*s) AS d3 FROM m)
       SELECT r.date, symbol, CASE WHEN week >= 26 AND n >= 4 THEN (a - ma)*d1/det + (b - mb)*d2/det + (c - mc)*d3/det
         ELSE (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) END AS prediction
       FROM r JOIN beta USING (date)""",
    "mranks target",
)
def combine_stack(t):
    return ensemble.combine(
        "stack", members(t), target=actual(t), members=["reversal", "trend", "cheap"], max_group=t.n_symbols
    )


# -- model versions ---------------------------------------------------------------------


@query(
    "h13_retrain_due", "date:d last_retrain:d due:i",
    """SELECT date, last_retrain, last_retrain IS NULL OR date - last_retrain >= 63 AS due FROM (
         SELECT d.date, max(p.retrain_date) AS last_retrain FROM (SELECT DISTINCT date FROM scores) d
         LEFT JOIN plan p ON p.retrain_date <= d.date GROUP BY d.date)""",
    "scores plan",
)
def retrain_due(t):
    weeks = portfolio_plans.staged_scores(t).select("date").distinct()
    return walkforward.retrain_due(weeks, plan(t).select(F.col("retrain_date").alias("date")), 9)


CAP = 156
# What each member is fitted with; the hash must change when any of it does.
MEMBER_PARAMS = {"forest": {"maxDepth": 8, "numTrees": 400}, "gbt": {"maxIter": 2000, "patience": 50, "stepSize": 0.03}}
RUN_PARTS = walkforward.run_parts(FEATURES, MEMBER_PARAMS, TRAIN, VAL, RETRAIN, "rolling", CAP, "thu")
SPEC_PARTS = ["forest,gbt", "rank_mean", RUN_PARTS[-1]]
quoted = ", ".join("'{}'".format(p) for p in RUN_PARTS[:-1])

view(
    "versions", "plan scores",
    f"""SELECT 'THU' AS signal_day, retrain_date AS bundle_retrain_date, sha1(concat_ws(chr(10), {quoted},
          string_agg(strftime(d.date, '%Y-%m-%d'), '|' ORDER BY d.date), '{RUN_PARTS[-1]}'))[1:16] AS fingerprint,
          sha1(concat_ws(chr(10), {", ".join("'{}'".format(p) for p in SPEC_PARTS)}, CAST(retrain_id // 5 AS VARCHAR)))[1:12] AS config_hash
        FROM plan JOIN (SELECT DISTINCT date FROM scores) d ON d.date BETWEEN train_from AND val_to GROUP BY retrain_date, retrain_id""",
)


def versions(t):
    """One row per retrain: a run fingerprint over its weeks, and a hash of its spec."""
    weeks = portfolio_plans.staged_scores(t).select("date").distinct()
    p = plan(t)
    used = weeks.join(walkforward.weeks_in(p, "train_from", "val_to"), "date")
    text = F.date_format("date", "yyyy-MM-dd")
    dated = used.groupBy("retrain_id", "retrain_date").agg(F.sort_array(F.collect_list(text)).alias("days"))
    *before, params = map(F.lit, RUN_PARTS)
    era = F.floor(F.col("retrain_id") / 5).cast("string")
    return dated.select(
        F.lit("THU").alias("signal_day"), F.col("retrain_date").alias("bundle_retrain_date"),
        walkforward.fingerprint([*before, F.array_join("days", "|"), params]).alias("fingerprint"),
        walkforward.fingerprint([*map(F.lit, SPEC_PARTS), era], 12).alias("config_hash"),
    )


@query("h14_run_fingerprint", "signal_day bundle_retrain_date:d fingerprint config_hash", "SELECT * FROM versions", "versions")
def run_fingerprint(t):
    return versions(t)


@query(
    "h15_spec_changes", "signal_day bundle_retrain_date:d config_hash",
    """SELECT signal_day, bundle_retrain_date, config_hash FROM (SELECT *, lag(config_hash) OVER (PARTITION BY signal_day ORDER BY bundle_retrain_date) AS p
         FROM versions) WHERE config_hash IS DISTINCT FROM p""",
    "versions",
)
def spec_changes(t):
    return walkforward.spec_changes(versions(t))


@query(
    "a12_version_gap_fill", "signal_day bundle_retrain_date:d config_hash",
    """SELECT signal_day, bundle_retrain_date, CASE WHEN bundle_retrain_date < DATE '1999-06-01' THEN 'authoritative' ELSE config_hash END AS config_hash
       FROM versions""",
    "versions",
)
def version_gap_fill(t):
    every = versions(t).drop("fingerprint")
    stored = every.filter("bundle_retrain_date < '1999-06-01'").withColumn("config_hash", F.lit("authoritative"))
    return store.insert_missing(stored, every, ["signal_day", "bundle_retrain_date"])


# -- attributions --------------------------------------------------------------------------

WEIGHTS = {"tilt": {"R1W": -1.0, "VOL6M": 0.5, "R1M": 0.25}, "size": {"R1W": -3.0, "VOL6M": -1.0, "R1M": 2.0}}
ATTR_COLS = ["R1W", "VOL6M", "R1M"]


def attributions(t):
    """Linear attributions of two weightings of z-scored factors, in long form."""
    df = factors.momentum(factors.r1w(t.grid))
    df = factors.risk_factors(df, factor_plans.market(t), full=False)
    z = xs.zscore(ts.weekly_last(df, ATTR_COLS), ATTR_COLS, max_group=t.n_symbols).na.fill(0.0)
    long = z.unpivot(["date", "symbol"], ATTR_COLS, "feature", "value")
    terms = F.explode(F.array(*[F.struct(
        F.lit(m).alias("member"), F.create_map(*[F.lit(x) for kv in w.items() for x in kv]).alias("w")
    ) for m, w in WEIGHTS.items()]))
    out = long.withColumn("s", terms)
    return t.staged("attributions", lambda: out.select(
        "date", "symbol", F.col("s.member").alias("member"), "feature", "value",
        (F.col("value") * F.element_at(F.col("s.w"), F.col("feature"))).alias("attr"),
    ))


Z3 = ", ".join(f"coalesce(({c} - avg({c}) OVER d) / nullif(stddev_samp({c}) OVER d, 0), 0) AS {c}" for c in ATTR_COLS)
view("zattr", "four", f"SELECT date, symbol, {Z3} FROM four WINDOW d AS (PARTITION BY date)")
view(
    "attr", "zattr",
    " UNION ALL ".join(
        f"SELECT date, symbol, '{m}' AS member, '{c}' AS feature, {c} AS value, {c} * {w[c]} AS attr FROM zattr"
        for m, w in WEIGHTS.items() for c in ATTR_COLS
    ),
)
view(
    "attr_avg", "attr",
    """SELECT date, symbol, feature, avg(CASE WHEN s > 0 THEN attr / s ELSE attr END) AS attr, min(value) AS value FROM attr
       JOIN (SELECT date, member, avg(abs(attr)) AS s FROM attr GROUP BY 1, 2) USING (date, member) GROUP BY 1, 2, 3""",
)


@query("h16_mean_abs_attribution", "member feature mean_abs:6",
       "SELECT member, feature, avg(abs(attr)) AS mean_abs FROM attr GROUP BY 1, 2", "attr")
def mean_abs_attribution(t):
    return ensemble.mean_abs_attribution(attributions(t))


@query("h16_average_members", "date:d symbol feature attr:5", "SELECT * FROM attr_avg", "attr_avg")
def average_members(t):
    return ensemble.average_members(attributions(t))


@query(
    "h16_top_drivers", "date:d symbol commentary",
    """SELECT date, symbol, string_agg(feature || CASE WHEN value >= 0 THEN ' high' ELSE ' low' END
         || CASE WHEN attr > 0 THEN ' (pushes score up)' ELSE ' (pushes score down)' END, '; ' ORDER BY r) AS commentary
       FROM (SELECT *, row_number() OVER (PARTITION BY date, symbol ORDER BY abs(attr) DESC, feature) AS r FROM attr_avg)
       WHERE r <= 2 AND attr <> 0 GROUP BY 1, 2""",
    "attr_avg",
)
def top_drivers(t):
    return ensemble.top_drivers(ensemble.average_members(attributions(t)))
