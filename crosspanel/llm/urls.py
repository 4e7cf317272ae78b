"""URL filter by the ratio of two character language models.

Rules decide some URLs; those they allow or block are the accepted and rejected examples.
For both, variable-order Markov models are counted over all pages: contexts of up to
``ORDER`` characters that occur ``MIN_CONTEXT`` times, each order smoothed with the one
below, P(c|ctx) = (n(ctx c) + BETA P(c|shorter ctx)) / (n(ctx) + BETA).  A URL's score is the
difference of its two log-likelihoods per character, each character predicted from the
longest context kept.

As contexts are closed under shortening, the difference telescopes: each string ctx+c gets
the change that it makes over the next shorter one, and a score is the sum over all
substrings of a URL.  Models and scores are therefore plain group-bys and joins.  Four fifths
of the example URLs (by crc32) train, the others set the threshold where the rates of
accepted and rejected URLs above it differ most, nearest to 0 on ties.

Substrings are counted over all URLs: the most common, at most ``HOT_GRAMS``, meet the model by
broadcast, as a key such as ``http`` is in every URL; the others by shuffle.  Equal URLs are
counted before anything is expanded.  A null URL or one without ``://`` has an empty host and
path and is scored as it is, a null as the empty text.  Without accepted or rejected examples
all scores are 0 and the verdict is allow.  Of rules of equal length the one of greater (host,
path) holds.  Long URLs are scored whole.  Repeated rows stay; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crosspanel.llm.text import hot_from
from crosspanel.session import stage

ORDER = 4
MIN_CONTEXT = 16
BETA = 4.0
# Fixed value: the characters told apart; "~" stands for all others, "$" ends a URL.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789:/._?=&#%-~$"
HOT_GRAMS = 250_000
RUN = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values: (verdict, host, path) of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule (host and path joined) and verdict of the longest rule that fits; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, v).otherwise(verdict)
    return rule, verdict


def spelled(url: Column) -> Column:
    """The URL in the model's alphabet, between ``^`` and ``$``."""
    text = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.concat(F.lit("^"), F.regexp_replace(text, r"[^a-z0-9:/._?=&#%-]", "~"), F.lit("$"))


def substrings(df: DataFrame, keep: list[str], longest: int = ORDER + 1) -> DataFrame:
    """One row per substring of ``s`` of up to ``longest`` characters, but ``^`` alone.

    Cut into overlapping runs first, as each substring is found by walking from the start.
    """
    runs = df.select(*keep, "s", F.explode(
        F.sequence(F.lit(1), F.length("s"), F.lit(RUN))).alias("first")).select(
        *keep, F.substr(F.col("s"), F.col("first"), F.lit(RUN + longest - 1)).alias("run"))
    n = F.length("run")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), n)), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)),
        lambda k: F.substr(F.col("run"), i, k))))
    return runs.select(*keep, F.explode(grams).alias("gram")).filter(F.col("gram") != "^")


def language_models(urls: DataFrame) -> DataFrame:
    """gram, change: the change of the log ratio that each kept context adds.

    ``urls`` has s, accepted and rejected (how many pages of each kind spell it so).
    """
    grams = stage(
        substrings(urls.filter("accepted + rejected > 0"), ["accepted", "rejected"])
        .groupBy("gram").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
        .withColumns({"c": F.right("gram", F.lit(1)),
                      "ctx": F.expr("left(gram, length(gram) - 1)")})
    )
    contexts = stage(
        grams.groupBy("ctx").agg(F.sum("a").alias("ctx_a"), F.sum("r").alias("ctx_r"))
        .filter((F.length("ctx") == 0) | (F.col("ctx_a") + F.col("ctx_r") >= MIN_CONTEXT))
    )
    letters = F.explode(F.array(*map(F.lit, ALPHABET))).alias("c")
    levels, below = [], None
    for order in range(ORDER + 1):
        level = (
            contexts.filter(F.length("ctx") == order).select("ctx", "ctx_a", "ctx_r", letters)
            .join(grams.filter(F.length("ctx") == order).select("ctx", "c", "a", "r"), ["ctx", "c"], "left")
            .fillna(0, ["a", "r"])
        )
        if below is None:
            level = level.withColumns({k: F.lit(1.0 / len(ALPHABET)) for k in ("below_a", "below_r")})
        else:
            shorter = below.select(F.col("ctx").alias("shorter"), "c",
                                   F.col("p_a").alias("below_a"), F.col("p_r").alias("below_r"))
            level = level.withColumn("shorter", F.expr("substr(ctx, 2)")).join(shorter, ["shorter", "c"])
        below = stage(level.select(
            "ctx", "c",
            ((F.col("a") + BETA * F.col("below_a")) / (F.col("ctx_a") + BETA)).alias("p_a"),
            ((F.col("r") + BETA * F.col("below_r")) / (F.col("ctx_r") + BETA)).alias("p_r"),
            "below_a", "below_r",
        ))
        levels.append(below.select(
            F.concat("ctx", "c").alias("gram"),
            (F.log(F.col("p_a") / F.col("p_r")) - F.log(F.col("below_a") / F.col("below_r"))).alias("change"),
        ))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def scores(urls: DataFrame, model: DataFrame, hot: int = HOT_GRAMS) -> DataFrame:
    """id, score of each row of ``urls`` (id, s): log-likelihood difference per character."""
    grams = substrings(urls, ["id"])
    used = stage(
        grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).join(model, "gram")
        .select("gram", "change", F.floor(F.log2("n") * 16).alias("spread"))
    )
    least = hot_from(used, hot)
    common = F.broadcast(used.filter(F.col("spread") >= least).select("gram", "change"))
    others = used.filter(F.col("spread") < least).select("gram", "change")
    rare = grams.join(common, "gram", "left_anti").join(others, "gram")
    sums = [part.groupBy("id").agg(F.sum("change").alias("sum")) for part in (grams.join(common, "gram"), rare)]
    total = sums[0].unionByName(sums[1]).groupBy("id").agg(F.sum("sum").alias("sum"))
    return total.join(urls.select("id", F.length("s").alias("n")), "id").select(
        "id", F.round(F.col("sum") / (F.col("n") - 1), 6).alias("score"))


def calibrated(examples: DataFrame) -> float:
    """The threshold for s, score, accepted, rejected rows; one number reaches the driver."""
    above = W.orderBy(F.col("bin").desc())
    whole = W.partitionBy(F.lit(0))
    best = (
        examples.groupBy(F.floor(F.col("score") * 100).alias("bin"))
        .agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
        .withColumns({"all_a": F.sum("a").over(whole), "all_r": F.sum("r").over(whole),
                      "up_a": F.sum("a").over(above), "up_r": F.sum("r").over(above)})
        .filter("all_a > 0 and all_r > 0")
        .select("bin", F.round(F.col("up_a") / F.col("all_a") - F.col("up_r") / F.col("all_r"), 9).alias("gap"))
        .orderBy(F.col("gap").desc(), F.abs("bin"), "bin")
        .first()
    )
    return best.bin / 100.0 if best else 0.0


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold."""
    host, path = host_and_path(F.col(url_col))
    rule, decided = by_rule(F.col("host"), F.col("path"), rules)
    rows = (
        pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"),
                     path.alias("path"), spelled(F.col(url_col)).alias("s"))
        .withColumns({"rule": rule, "decided": decided})
    )
    # A URL grows to some hundred rows, so the stored table is spread over all partitions; by a
    # hash of its own, as a partitioning by s would be taken for the one of the group-by.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = stage(rows.groupBy("s").agg(
        F.count_if(F.col("decided") == "allow").alias("accepted"),
        F.count_if(F.col("decided") == "block").alias("rejected"),
    ).repartition(parts, F.xxhash64("s")).withColumn("id", F.monotonically_increasing_id()))
    train = F.crc32(F.col("s").cast("binary")) % 5 != 0
    scored = stage(urls.join(scores(urls, stage(language_models(urls.filter(train)))), "id").select("s", "score"))
    threshold = calibrated(
        urls.filter(~train).filter("accepted + rejected > 0").join(scored, "s")
    )
    return rows.join(scored, "s", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("decided", F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block"))
        .alias("verdict"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.lit(threshold).alias("threshold"),
    )
