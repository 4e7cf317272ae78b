"""Per-name research tables: earnings, valuation, consensus, briefs, articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.universe import is_us_listing


def surprise_pct(actual: Column, estimate: Column) -> Column:
    """Percent beat or miss; undefined against an estimate that is not positive."""
    return F.when(estimate > 0, F.round((actual / estimate - 1) * 100, 2))


def earnings(rows: DataFrame, as_of: Column, target: Column) -> DataFrame:
    """Last report with an actual up to ``as_of`` and the next scheduled one, per symbol."""
    fields = F.struct("date", "eps_actual", "eps_estimated", "revenue_actual", "revenue_estimated")
    past = (F.col("date") <= as_of) & F.col("eps_actual").isNotNull()
    ahead = F.col("date") > as_of
    both = rows.groupBy("symbol").agg(
        F.max_by(fields, F.when(past, F.col("date"))).alias("l"),
        F.min_by(fields, F.when(ahead, F.col("date"))).alias("n"),
    )
    nxt = F.col("n.date")
    return both.select(
        "symbol",
        F.col("l.date").alias("last_date"),
        F.col("l.eps_actual").alias("eps_actual"),
        F.col("l.eps_estimated").alias("eps_estimated"),
        surprise_pct(F.col("l.eps_actual"), F.col("l.eps_estimated")).alias("eps_surprise_pct"),
        surprise_pct(F.col("l.revenue_actual"), F.col("l.revenue_estimated")).alias("revenue_surprise_pct"),
        nxt.alias("next_date"),
        F.datediff(nxt, as_of).alias("days_until"),
        ((nxt > as_of) & (nxt <= target)).alias("in_holding_week"),
    )


def valuation(metrics: DataFrame, ratios: DataFrame) -> DataFrame:
    """Multiples as they come, margins and yields in percent."""
    pct = lambda col: F.round(F.col(col) * 100, 2)
    df = metrics.join(ratios, "symbol", "full_outer")
    return df.select(
        "symbol", "pe_ttm", "pb_ttm", "ev_ebitda_ttm", "ev_sales_ttm", "debt_to_equity_ttm",
        pct("gross_margin").alias("gross_margin_ttm"), pct("roe").alias("roe_ttm"),
        pct("fcf_yield").alias("fcf_yield_ttm"),
    )


def nearest_estimate(rows: DataFrame, today: Column, key: str = "symbol") -> DataFrame:
    """The first estimate dated after ``today``, else the earliest one."""
    cols = [c for c in rows.columns if c != key]
    future = F.min_by(F.struct(*cols), F.when(F.col("date") > today, F.col("date")))
    earliest = F.min_by(F.struct(*cols), "date")
    return rows.groupBy(key).agg(F.coalesce(future, earliest).alias("r")).select(key, "r.*")


def consensus(names: DataFrame, ratings: DataFrame, targets: DataFrame, prices: DataFrame) -> DataFrame:
    """Rating counts, price target against the last close, and why a panel is empty.

    ``names`` is (symbol, code); ``targets`` has avg_month and avg_quarter.
    """
    df = (
        names.join(ratings.withColumn("_r", F.lit(True)), "symbol", "left")
        .join(targets.withColumn("_t", F.lit(True)), "symbol", "left")
        .join(prices, "symbol", "left")
    )
    available = F.coalesce("_r", F.lit(False)) | F.coalesce("_t", F.lit(False))
    avg = F.coalesce(F.nullif("avg_month", F.lit(0.0)), F.nullif("avg_quarter", F.lit(0.0)))
    reason = F.when(~available & ~is_us_listing(F.col("code")), "no coverage outside US listings").when(
        ~available, "no consensus for this symbol"
    )
    return df.withColumns(
        {
            "available": available,
            "reason": reason,
            "avg_pt": avg,
            "pt_vs_price_pct": F.round((F.try_divide(avg, F.col("price")) - 1) * 100, 2),
        }
    ).drop("_r", "_t")


def flatten_dossier(dossiers: DataFrame) -> DataFrame:
    """One flat row per name; a missing nested block gives nulls."""
    return dossiers.select(
        "symbol", "side", "fundamentals.last.eps_surprise_pct", "fundamentals.next.days_until",
        "technicals.verdict", "technicals.z20",
    )


def sector_mix(picks: DataFrame, by: list[str]) -> DataFrame:
    """Long and short counts per group and the net tilt."""
    is_long = F.col("side") == "LONG"
    out = picks.groupBy(*by).agg(
        F.count_if(is_long).alias("LONG"), F.count_if(~is_long).alias("SHORT")
    )
    return out.withColumn("net", F.col("LONG") - F.col("SHORT"))


def largest_moves(rows: DataFrame, n: int = 15, move: str = "move_since_signal_pct") -> DataFrame:
    """The n largest absolute moves, with the number of rows not shown."""
    present = rows.filter(F.col(move).isNotNull())
    total = present.agg(F.count(F.lit(1))).scalar()
    top = present.orderBy(F.desc(F.abs(move)), "symbol").limit(n)
    return top.withColumn("hidden", F.greatest(total - n, F.lit(0)))


def screening_order(align: Column) -> Column:
    """Sort key: conflicts first, then aligned, then neutral."""
    return F.when(align == "conflict", 0).when(align == "aligned", 1).otherwise(2)


# -- briefs ----------------------------------------------------------------------

# The shape a brief must have.
REQUIRED = ["thesis", "theme", "fundamental_read", "technical_read"]
LIST_LIMITS = {"headline_risks": 4, "catalysts": 3, "sources_used": 12}
ENUMS = {
    "model_agreement": (["agrees", "partly", "disagrees"], "partly"),
    "confidence": (["low", "medium", "high"], "low"),
}
MAX_THESIS_WORDS = 25
FENCE = r"(?m)^\s*```(?:json)?\s*|\s*```\s*$"


# Names of JSON types in the messages, by how Spark spells a variant's schema.
JSON_TYPES = {"STRING": "str", "ARRAY": "list", "OBJECT": "dict", "BOOLEAN": "bool", "BIGINT": "int",
              "DECIMAL": "float", "DOUBLE": "float", "VOID": "NoneType"}


def json_type(v: Column) -> Column:
    """Type name of a variant value; null where there is none."""
    kind, out = F.schema_of_variant(v), F.lit(None).cast("string")
    for spelled, name in JSON_TYPES.items():
        out = F.when(kind.startswith(spelled), name).otherwise(out)
    # A whole number with more digits than a long is a decimal without a fraction.
    return F.when(kind.rlike(r"^DECIMAL\(\d+,0\)"), "int").otherwise(out)


def _as_text(v: Column) -> Column:
    """A list item as text; nested objects and lists as their JSON."""
    kind = json_type(v)
    return (
        F.when(kind == "bool", F.initcap(F.to_json(v)))
        .when(kind.isNull() | (kind == "NoneType"), "None")
        .when(kind.isin("dict", "list"), F.to_json(v))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )


def parse_briefs(texts: DataFrame, text: str = "text") -> DataFrame:
    """Text to validated brief columns plus ``problem``.

    Fences are stripped.  If what is left is JSON it must be an object; otherwise the
    outermost braces are taken.  Four strings are required, lists are trimmed (a lone string
    is a list of one, a falsy value an empty list, items of other types become text), and
    enumerations fall back to defaults.  All of it is column expressions over the texts.
    """
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), FENCE, ""))
    df = texts.withColumn("_all", body).withColumn("_whole", F.try_parse_json("_all"))
    inner = F.regexp_extract("_all", r"(?s)\{.*\}", 0)
    df = df.withColumn("_body", F.when(F.col("_whole").isNotNull(), F.col("_all")).otherwise(inner))
    df = df.withColumn("_v", F.try_parse_json("_body")).withColumn("_type", json_type(F.col("_v")))
    get = lambda k, t: F.try_variant_get("_v", f"$.{k}", t)
    kinds = [*REQUIRED, *LIST_LIMITS]
    df = df.withColumns({f"_t_{k}": json_type(get(k, "variant")) for k in kinds})
    strings = {k: F.when(F.col(f"_t_{k}") == "str", F.trim(get(k, "string"))) for k in REQUIRED}
    df = df.withColumns({f"_{k}": v for k, v in strings.items()})
    missing = F.concat_ws(
        ", ", *[F.when(F.coalesce(F.col(f"_{k}"), F.lit("")) == "", F.lit(k)) for k in REQUIRED]
    )
    lists, bad_lists = {}, []
    for k, limit in LIST_LIMITS.items():
        kind = F.col(f"_t_{k}")
        items = F.transform(get(k, "array<variant>"), lambda x: F.trim(_as_text(x)))
        raw = F.when(kind == "str", F.array(F.trim(get(k, "string")))).when(kind == "list", items)
        clean = F.filter(raw, lambda s: s != "")
        lists[k] = F.slice(F.coalesce(clean, F.array().cast("array<string>")), 1, limit)
        number = F.coalesce(get(k, "double"), F.lit(0.0))
        falsy = (kind == "NoneType") | kind.isNull() | ((kind == "bool") & ~F.coalesce(get(k, "boolean"), F.lit(False)))
        falsy = falsy | (kind.isin("int", "float") & (number == 0)) | (F.to_json(get(k, "variant")) == "{}")
        bad_lists.append(F.when(
            ~kind.isin("str", "list") & ~falsy, F.concat(F.lit(f"{k} must be a list, got "), kind)
        ))
    problem = (
        F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "empty response")
        .when(F.col("_body") == "", "no JSON object found in response")
        .when(F.col("_v").isNull(), "invalid JSON")
        .when(F.col("_type") != "dict", F.concat(F.lit("expected a JSON object, got "), F.col("_type")))
        .when(missing != "", F.concat(F.lit("missing or non-string keys: "), missing))
        .otherwise(F.coalesce(*bad_lists))
    )
    df = df.withColumn("problem", problem).withColumns({f"_{k}": v for k, v in lists.items()})
    words = F.split("_thesis", r"\s+")
    thesis = F.when(
        F.size(words) > MAX_THESIS_WORDS,
        F.concat(F.array_join(F.slice(words, 1, MAX_THESIS_WORDS), " "), F.lit("…")),
    ).otherwise(F.col("_thesis"))
    good = F.col("problem").isNull()
    out = {"thesis": F.when(good, thesis)}
    out |= {k: F.when(good, F.col(f"_{k}")) for k in [*REQUIRED[1:], *LIST_LIMITS]}
    for k, (allowed, default) in ENUMS.items():
        v = F.lower(F.trim(get(k, "string")))
        out[k] = F.when(good, F.when(v.isin(allowed), v).otherwise(default))
    keep = [c for c in texts.columns if c not in out]
    return df.withColumns(out).select(*keep, *out, "problem")


def brief_coverage(parsed: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Every name or brief with its outcome: merged, a problem, unknown or missing."""
    known = names.select(key).distinct().withColumn("_known", F.lit(True))
    both = parsed.withColumn("_given", F.lit(True)).join(known, key, "full_outer")
    status = (
        F.when(F.col("_known").isNull(), "not in this artifact")
        .when(F.col("_given").isNull(), "no brief supplied")
        .otherwise(F.coalesce("problem", F.lit("merged")))
    )
    return both.select(key, status.alias("status"))


def clean_articles(rows: DataFrame, snippet_chars: int = 350) -> DataFrame:
    """Publisher host without ``www.``, snippet cut, score rounded."""
    host = F.expr("parse_url(url, 'HOST')")
    return rows.withColumns(
        {
            "publisher": F.regexp_replace(host, r"^www\.", ""),
            "snippet": F.substring(F.coalesce("content", F.lit("")), 1, snippet_chars),
            "score": F.round("score", 3),
        }
    )
