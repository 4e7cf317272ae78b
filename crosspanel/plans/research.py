"""Queries for the per-name research tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosspanel.functions import ts, xs
from crosspanel.operators import research as r
from crosspanel.operators import technicals as tech
from crosspanel.plans import forecast as forecast_plans
from crosspanel.plans import technicals as tech_plans
from crosspanel.plans import universe as universe_plans
from crosspanel.plans.registry import query
from crosspanel.plans.sql import view

day = lambda s: F.lit(s).cast("date")


@query(
    "l1_surprise", "symbol date:d surprise:2",
    """SELECT symbol, date, CASE WHEN e > 0 THEN round((a / e - 1) * 100, 2) END AS surprise FROM (
         SELECT symbol, date, net_income AS a, lag(net_income) OVER (PARTITION BY symbol ORDER BY date) AS e FROM statements)""",
    "statements",
)
def surprise(t):
    w = Window.partitionBy("symbol").orderBy("date")
    prior = F.lag("net_income").over(w)
    return t.statements.withColumn("e", prior).withColumn(
        "surprise", r.surprise_pct(F.col("net_income"), F.col("e"))
    )


AS_OF, TARGET = "2001-06-27", "2001-07-04"
view(
    "earn", "statements",
    """SELECT symbol, date, CASE WHEN date <= DATE '2001-06-30' AND symbol % 4 <> 0 THEN net_income / shares END AS eps_actual,
         lag(net_income / shares) OVER w AS eps_estimated, revenue AS revenue_actual, lag(revenue) OVER w AS revenue_estimated
       FROM statements WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
)


def earnings_rows(t):
    w = Window.partitionBy("symbol").orderBy("date")
    eps = ts.ratio(F.col("net_income"), F.col("shares"))
    known = (F.col("date") <= day("2001-06-30")) & (F.col("symbol") % 4 != 0)
    return t.statements.withColumn("eps", eps).select(
        "symbol", "date", F.when(known, F.col("eps")).alias("eps_actual"),
        F.lag("eps").over(w).alias("eps_estimated"), F.col("revenue").alias("revenue_actual"),
        F.lag("revenue").over(w).alias("revenue_estimated"),
    )


@query(
    "l2_earnings", "symbol last_date:d eps_actual:5 eps_estimated:5 eps_surprise_pct:2 revenue_surprise_pct:2 next_date:d days_until:0 in_holding_week:0",
    f"""SELECT *, round((eps_actual / CASE WHEN eps_estimated > 0 THEN eps_estimated END - 1) * 100, 2) AS eps_surprise_pct,
          round((ra / CASE WHEN re > 0 THEN re END - 1) * 100, 2) AS revenue_surprise_pct, next_date - DATE '{AS_OF}' AS days_until,
          CAST(next_date > DATE '{AS_OF}' AND next_date <= DATE '{TARGET}' AS INTEGER) AS in_holding_week FROM (
        SELECT symbol, max(date) FILTER (WHERE past) AS last_date, arg_max(eps_actual, date) FILTER (WHERE past) AS eps_actual,
          arg_max(eps_estimated, date) FILTER (WHERE past) AS eps_estimated, arg_max(revenue_actual, date) FILTER (WHERE past) AS ra,
          arg_max(revenue_estimated, date) FILTER (WHERE past) AS re, min(date) FILTER (WHERE date > DATE '{AS_OF}') AS next_date
        FROM (SELECT *, date <= DATE '{AS_OF}' AND eps_actual IS NOT NULL AS past FROM earn) GROUP BY symbol)""",
    "earn",
)
def earnings(t):
    return r.earnings(earnings_rows(t), day(AS_OF), day(TARGET)).withColumn(
        "in_holding_week", F.col("in_holding_week").cast("int")
    )


def latest_report(t):
    """Each symbol's last report, stored: net income near 0 must not differ between its readers,
    nor with the order its money is added up in."""
    cols = ["net_income", "total_equity", "revenue", "gross_profit", "ebitda", "total_debt", "shares", "free_cash_flow"]
    latest = t.reports(xs.exact_sum).groupBy("symbol").agg(F.max_by(F.struct(*cols), "date").alias("q"))
    return t.staged("latest report", lambda: latest.select("symbol", "q.*"))


@query(
    "l3_valuation", "symbol pe_ttm:5 pb_ttm:5 ev_ebitda_ttm:5 ev_sales_ttm:5 debt_to_equity_ttm:5 gross_margin_ttm:2 roe_ttm:2 fcf_yield_ttm:2",
    """WITH q AS (SELECT symbol, arg_max(net_income, date) AS ni, arg_max(net_income, date) AS net, arg_max(total_equity, date) AS eq, arg_max(revenue, date) AS rev,
         arg_max(gross_profit, date) AS gp, arg_max(ebitda, date) AS ebitda, arg_max(total_debt, date) AS debt, arg_max(shares, date) AS sh,
         arg_max(free_cash_flow, date) AS fcf FROM statements GROUP BY symbol)
       SELECT symbol, eq / nullif(ni, 0) AS pe_ttm, rev / nullif(eq, 0) AS pb_ttm, (eq + debt) / nullif(ebitda, 0) AS ev_ebitda_ttm,
         CASE WHEN net > 0 THEN (eq + debt) / rev END AS ev_sales_ttm, debt / nullif(eq, 0) AS debt_to_equity_ttm,
         round(gp / rev * 100, 2) AS gross_margin_ttm, CASE WHEN net > 0 THEN round(ni / nullif(eq, 0) * 100, 2) END AS roe_ttm,
         CASE WHEN net > 0 THEN round(fcf / nullif(eq, 0) * 100, 2) END AS fcf_yield_ttm FROM (
           SELECT q.* REPLACE (CASE WHEN net > 0 THEN ebitda END AS ebitda) FROM q)""",
    "statements",
)
def valuation(t):
    q, c = latest_report(t), F.col
    metrics = q.filter("net_income > 0").select(
        "symbol", ts.ratio(c("total_equity") + c("total_debt"), c("ebitda")).alias("ev_ebitda_ttm"),
        ts.ratio(c("total_equity") + c("total_debt"), c("revenue")).alias("ev_sales_ttm"),
        ts.ratio(c("net_income"), c("total_equity")).alias("roe"),
        ts.ratio(c("free_cash_flow"), c("total_equity")).alias("fcf_yield"),
    )
    ratios = q.select(
        "symbol", ts.ratio(c("total_equity"), c("net_income")).alias("pe_ttm"),
        ts.ratio(c("revenue"), c("total_equity")).alias("pb_ttm"),
        ts.ratio(c("total_debt"), c("total_equity")).alias("debt_to_equity_ttm"),
        ts.ratio(c("gross_profit"), c("revenue")).alias("gross_margin"),
    )
    return r.valuation(metrics, ratios)


@query(
    "l4_nearest_estimate", "symbol date:d revenue:2",
    """SELECT symbol, coalesce(min(date) FILTER (WHERE date > DATE '2001-02-15'), min(date)) AS date,
         coalesce(arg_min(revenue, date) FILTER (WHERE date > DATE '2001-02-15'), arg_min(revenue, date)) AS revenue
       FROM statements GROUP BY symbol""",
    "statements",
)
def nearest_estimate(t):
    rows = t.statements.select("symbol", "date", "revenue")
    return r.nearest_estimate(rows, day("2001-02-15"))


@query(
    "l5_consensus", "symbol available:i reason buys:0 avg_pt:2 pt_vs_price_pct:2",
    f"""WITH names AS (SELECT s_suppkey AS symbol, code FROM ({universe_plans.SYMBOL_SQL})),
       rt AS (SELECT user_id AS symbol, count(*) FILTER (WHERE event_type = 'purchase') AS buys FROM events GROUP BY 1),
       pt AS (SELECT l_suppkey AS symbol, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > count(*) FILTER (WHERE l_returnflag = 'A') THEN avg(l_extendedprice) ELSE 0.0 END AS m, avg(l_extendedprice) * 1.1 AS q
              FROM lineitem GROUP BY 1),
       px AS (SELECT symbol, arg_max(close, date) AS price FROM bars GROUP BY symbol)
       SELECT symbol, rt.symbol IS NOT NULL OR pt.symbol IS NOT NULL AS available,
         CASE WHEN rt.symbol IS NULL AND pt.symbol IS NULL THEN CASE WHEN code LIKE '%.TO' OR code LIKE '%.L'
           THEN 'no coverage outside US listings' ELSE 'no consensus for this symbol' END END AS reason, buys,
         coalesce(nullif(m, 0), nullif(q, 0)) AS avg_pt, round((coalesce(nullif(m, 0), nullif(q, 0)) / price - 1) * 100, 2) AS pt_vs_price_pct
       FROM names LEFT JOIN rt USING (symbol) LEFT JOIN pt USING (symbol) LEFT JOIN px USING (symbol)""",
    "bars",
)
def consensus(t):
    names = universe_plans.listing_codes(t).withColumnRenamed("s_suppkey", "symbol")
    ratings = t.read("events").groupBy(F.col("user_id").alias("symbol")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("buys")
    )
    avg = F.avg("l_extendedprice")
    targets = t.read("lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(
        F.when(F.count_if(F.col("l_returnflag") == "R") > F.count_if(F.col("l_returnflag") == "A"), avg).otherwise(0.0).alias("avg_month"), (avg * 1.1).alias("avg_quarter")
    )
    from crosspanel.operators.orders import last_prices

    return r.consensus(names, ratings, targets, last_prices(t.bars))


@query(
    "l6_flatten_dossier", "symbol side eps_surprise_pct:2 days_until:0 verdict z20:4",
    f"""SELECT a.symbol, a.side, CASE WHEN e.eps_estimated > 0 THEN round((e.eps_actual / e.eps_estimated - 1) * 100, 2) END AS eps_surprise_pct,
          next_date - DATE '{AS_OF}' AS days_until, verdict, z20
        FROM aligned a LEFT JOIN (SELECT symbol, arg_max(eps_actual, date) FILTER (WHERE past) AS eps_actual,
          arg_max(eps_estimated, date) FILTER (WHERE past) AS eps_estimated, min(date) FILTER (WHERE date > DATE '{AS_OF}') AS next_date
          FROM (SELECT *, date <= DATE '{AS_OF}' AND eps_actual IS NOT NULL AS past FROM earn) GROUP BY symbol) e USING (symbol)""",
    "aligned earn",
)
def flatten_dossier(t):
    e = r.earnings(earnings_rows(t), day(AS_OF), day(TARGET)).select(
        "symbol",
        F.struct(
            F.struct("eps_actual", "eps_surprise_pct").alias("last"),
            F.struct("next_date", "days_until").alias("next"),
        ).alias("fundamentals"),
    )
    read = tech_plans.read(t).select("symbol", "side", F.struct("verdict", "z20").alias("technicals"))
    return r.flatten_dossier(read.join(e, "symbol", "left"))


@query(
    "l7_sector_mix", "scope industry LONG:i SHORT:i net:i",
    """SELECT scope, industry, count(*) FILTER (WHERE side = 'LONG') AS LONG, count(*) FILTER (WHERE side = 'SHORT') AS SHORT,
         count(*) FILTER (WHERE side = 'LONG') - count(*) FILTER (WHERE side = 'SHORT') AS net FROM picks GROUP BY 1, 2""",
    "picks",
)
def sector_mix(t):
    return r.sector_mix(forecast_plans.picks(t), ["scope", "industry"])


def briefs(t):
    """Replies of every shape a model produces, around the conversation texts."""
    v = (F.col("conv_id") * 3 + F.col("turn")) % 10
    fields = {
        "thesis": F.col("text"), "theme": F.col("role"), "fundamental_read": F.lit(" solid "),
        "technical_read": F.lit("neutral"), "headline_risks": F.array(*[F.lit(x) for x in ("a", " b ", "", "c", "d", "e")]),
        "catalysts": F.lit("one only"), "model_agreement": F.lit(" Agrees"), "confidence": F.lit("sky-high"),
    }
    js = lambda drop=(): F.to_json(F.struct(*[c.alias(k) for k, c in fields.items() if k not in drop]))
    body = (
        F.when(v == 0, F.concat(F.lit("```json\n"), js(), F.lit("\n```")))
        .when(v == 1, F.concat(F.lit("Here is the brief: "), js(), F.lit(" Hope it helps.")))
        .when(v == 2, js(("theme",)))
        .when(v == 3, F.concat(F.lit('{"thesis": "'), F.lit("cut off}")))
        .when(v == 4, F.lit("   "))
        .when(v == 5, F.lit("no structured answer"))
        .when(v == 7, F.concat(F.lit("["), js(), F.lit("]")))
        .when(v == 8, F.regexp_replace(js(), r'"headline_risks":\[[^]]*\]', '"headline_risks":false,"sources_used":[1,true,null," x "]'))
        .when(v == 9, F.regexp_replace(js(), r'"catalysts":"one only"', '"catalysts":{"a":1}'))
        .otherwise(js())
    )
    return t.read("conversations").select("conv_id", "turn", v.alias("v"), body.alias("text"))


view(
    "brief_expect", "",
    r"""SELECT conv_id, turn, v, CASE v WHEN 2 THEN 'missing or non-string keys: theme' WHEN 3 THEN 'invalid JSON' WHEN 4 THEN 'empty response'
         WHEN 5 THEN 'no JSON object found in response'
         WHEN 7 THEN 'expected a JSON object, got list' WHEN 9 THEN CASE WHEN length(tx) = 0 THEN 'missing or non-string keys: thesis'
           ELSE 'catalysts must be a list, got dict' END ELSE CASE WHEN length(tx) = 0 THEN 'missing or non-string keys: thesis' END END AS problem,
         words, tx, role FROM (SELECT *, (conv_id * 3 + turn) % 10 AS v, trim(text, E' \n\t\r') AS tx,
           regexp_split_to_array(trim(text, E' \n\t\r'), '\s+') AS words FROM conversations)""",
)


@query(
    "l10_validate_briefs", "conv_id:i turn:i problem thesis theme fundamental_read risks catalysts sources model_agreement confidence",
    """SELECT conv_id, turn, problem, CASE WHEN ok THEN CASE WHEN len(words) > 25 THEN array_to_string(words[1:25], ' ') || '…' ELSE tx END END AS thesis,
         CASE WHEN ok THEN role END AS theme, CASE WHEN ok THEN 'solid' END AS fundamental_read, CASE WHEN ok THEN CASE WHEN v = 8 THEN '' ELSE 'a,b,c,d' END END AS risks,
         CASE WHEN ok THEN 'one only' END AS catalysts, CASE WHEN ok THEN CASE WHEN v = 8 THEN '1,True,None,x' ELSE '' END END AS sources, CASE WHEN ok THEN 'agrees' END AS model_agreement, CASE WHEN ok THEN 'low' END AS confidence
       FROM (SELECT *, problem IS NULL AS ok FROM brief_expect)""",
    "brief_expect",
)
def validate_briefs(t):
    out = r.parse_briefs(briefs(t))
    # array_join of a null array is null, so rejected briefs stay null.
    return out.withColumns(
        {"risks": F.array_join("headline_risks", ","), "catalysts": F.array_join("catalysts", ","),
         "sources": F.array_join("sources_used", ",")}
    )


@query(
    "l10_brief_coverage", "conv_id:i status",
    """WITH given AS (SELECT conv_id, CASE max(CASE WHEN problem IS NULL THEN 1 ELSE 0 END) WHEN 1 THEN 'merged' ELSE min(problem) END AS s
         FROM brief_expect GROUP BY conv_id),
       names AS (SELECT DISTINCT doc_id AS conv_id FROM labels)
       SELECT coalesce(g.conv_id, n.conv_id) AS conv_id, CASE WHEN n.conv_id IS NULL THEN 'not in this artifact'
         WHEN g.conv_id IS NULL THEN 'no brief supplied' ELSE s END AS status
       FROM given g FULL JOIN names n ON g.conv_id = n.conv_id""",
    "brief_expect",
)
def brief_coverage(t):
    # Of several replies for a name a good one counts, else the first problem by name.
    parsed = r.parse_briefs(briefs(t)).groupBy("conv_id").agg(
        F.when(F.count_if(F.col("problem").isNull()) == 0, F.min("problem")).alias("problem")
    )
    names = t.read("labels").select(F.col("doc_id").alias("conv_id"))
    return r.brief_coverage(parsed, names, "conv_id")


@query(
    "l11_clean_articles", "page_id:i publisher snippet score:3",
    r"""SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS publisher,
          html[1:350] AS snippet, round(page_id / 7.0, 3) AS score FROM pages""",
)
def clean_articles(t):
    rows = t.read("pages").select("page_id", "url", F.col("html").alias("content"), (F.col("page_id") / 7.0).alias("score"))
    return r.clean_articles(rows)
