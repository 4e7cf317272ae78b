"""Weekly factors of many symbols at once, on dense [symbols, sessions] arrays.

A window on the daily grid sorts the grid once for each order, and a matrix of all factors sorts
it some twenty times, every copy wider than its bars.  Here bars, reports and actions are
shuffled by symbol once, before they are repeated over the calendar.  A task takes its symbols in
blocks, fills one array for each series, and gives a row a week; only a block is held.

The formulas are those of ``factors`` and ``fundamentals``, null written as nan.  Window sums are
the tail of one block of rows and the head of the next, as in ``ts.moving_sums``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.operators import factors, fundamentals, joins
from crosspanel.operators.factors import ANNUAL, HALF_YEAR, MOMENTUM, RESIDUAL_PERIODS, YEAR

# Cells of one array of a block; about a hundred arrays are alive at a time.
CELLS = 120_000
BAR, REPORT, ACTIONS = 0, 1, 2
RATINGS = "UPDOWN1W_RATINGS"
CARRIED = [*fundamentals.TRAILING.values(), *fundamentals.STOCK_ITEMS, *fundamentals.REPORT_RATIOS]
RSI_SPANS = {"RSI5D": 5, "RSI14": 14, "RSI30": 30}


def ratio(num, den):
    """num / den, nan where the denominator is 0."""
    return num / np.where(den == 0, np.nan, den)


def zero(x):
    return np.where(np.isnan(x), 0.0, x)


def lag(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full_like(x, np.nan)
    if n < x.shape[1]:
        out[:, n:] = x[:, :x.shape[1] - n] if n else x
    return out


def change(x: np.ndarray, n: int) -> np.ndarray:
    return ratio(x, lag(x, n)) - 1


def moving_sum(x: np.ndarray, rows: int) -> np.ndarray:
    """Trailing sums over ``rows`` sessions, nan counted as 0; nothing is subtracted."""
    names, days = x.shape
    parts = -(-days // rows)
    cut = np.zeros((names, parts * rows))
    cut[:, :days] = zero(x)
    cut = cut.reshape(names, parts, rows)
    out = cut.cumsum(2)
    tail = cut[:, :, ::-1].cumsum(2)[:, :, ::-1]
    # Row k of a part adds the rows after k of the part before.
    out[:, 1:, :-1] += tail[:, :-1, 1:]
    return out.reshape(names, -1)[:, :days]


def doubled(x: np.ndarray, rows: int) -> np.ndarray:
    return x + zero(lag(x, rows))


def deviation(n, s, ss, least: int) -> np.ndarray:
    """Annualized sample deviation, nan below ``least`` values."""
    var = np.maximum((ss - s * s / n) / (n - 1), 0.0)
    return np.where((n >= least) & (n > 1), np.sqrt(var) * ANNUAL, np.nan)


def beta(n, sx, sxy, rows: int, y_mean, y_var) -> np.ndarray:
    return np.where(n >= rows, ratio(sxy / rows - (sx / rows) * y_mean, y_var), np.nan)


def price_factors(px, close) -> dict[str, np.ndarray]:
    out = {"R1W": change(px, 5)}
    out |= {name: ratio(lag(close, skip), lag(close, look)) - 1 for name, (look, skip) in MOMENTUM.items()}
    return out


def rsi(close) -> dict[str, np.ndarray]:
    """``factors.rsi``: both sums decay by a row, all spans in one pass over the sessions."""
    move = close - lag(close, 1)
    seen = ~np.isnan(move)
    x = np.stack([np.maximum(zero(move), 0.0), np.maximum(-zero(move), 0.0)])
    q = 1.0 - 1.0 / np.array(list(RSI_SPANS.values()), float)[:, None, None]
    sums = np.zeros((len(RSI_SPANS), 2, len(close)))  # gains and losses; their weights are common
    weight = np.zeros((len(RSI_SPANS), 1, len(close)))
    held = np.full((len(RSI_SPANS), 2, *close.shape), np.nan)
    last = np.full(sums.shape, np.nan)
    for t in range(close.shape[1]):
        sums, weight = sums * q + x[:, :, t], weight * q + seen[:, t]
        last = np.where(seen[:, t], sums / weight, last)
        held[..., t] = last
    count = seen.cumsum(1)
    return {
        name: np.where(count >= n, 100 - 100 / (1 + ratio(held[i, 0], held[i, 1])), np.nan)
        for i, (name, n) in enumerate(RSI_SPANS.items())
    }


def risk_factors(px, market: dict[str, np.ndarray], full: bool) -> dict[str, np.ndarray]:
    """``factors.risk_factors`` at its defaults; volatilities only unless ``full``."""
    h, y = HALF_YEAR, YEAR
    r = change(px, 1)
    n, s, ss = (moving_sum(x, h) for x in (~np.isnan(r) * 1.0, r, r * r))
    n2, s2, ss2 = (doubled(x, h) for x in (n, s, ss))
    neg = np.where(r < 0, r, np.nan)
    out = {
        "VOL6M": deviation(n, s, ss, h // 2), "VOL12M": deviation(n2, s2, ss2, y // 2),
        "DOWNVOL6M": deviation(*(moving_sum(x, h) for x in ((r < 0) * 1.0, neg, neg * neg)), h // 2),
    }
    if not full:
        return out
    m = market["mkt_close_ret"]
    sm = moving_sum(r * m, h)
    out["BETA6M"] = beta(n, s, sm, h, market[f"mkt_close_mean{h}"], market[f"mkt_close_var{h}"])
    out["BETA12M"] = beta(n2, s2, doubled(sm, h), y, market[f"mkt_close_mean{y}"], market[f"mkt_close_var{y}"])
    for name, b, least in (("IVOL6M", "BETA6M", h // 2), ("IVOL12M", "BETA12M", y // 2)):
        res = r - out[b] * m
        res = np.where(np.isnan(res), r, res)  # before beta exists the residual is the raw return
        sums = [moving_sum(x, h) for x in (~np.isnan(res) * 1.0, res, res * res)]
        out[name] = deviation(*(sums if b == "BETA6M" else [doubled(x, h) for x in sums]), least)
    left = {p: change(px, p) - out["BETA6M"] * market[f"mkt_ret{p}"] for p in RESIDUAL_PERIODS}
    out |= {"IREV1W": left[5], "IREV1M": left[21], "IMOM12M1M": lag(left[252], 21), "IMOM3M1M": lag(left[63], 21)}
    out |= {name: ratio(out[a], out[b]) for name, a, b in (
        ("IMOMVOL12M1M", "IMOM12M1M", "IVOL12M"), ("IMOMVOL3M1M", "IMOM3M1M", "IVOL6M"),
        ("IREVVOL1W", "IREV1W", "IVOL6M"), ("IREVVOL1M", "IREV1M", "IVOL6M"))}
    return out


def sensitivities(px, series: dict[str, np.ndarray], names: Sequence[str]) -> dict[str, np.ndarray]:
    h, r = HALF_YEAR, change(px, 1)
    s, out = moving_sum(r, h), {}
    for x in names:
        both = r * series[f"{x}_ret"]
        n = moving_sum(~np.isnan(both) * 1.0, h)
        out[f"BETA_{x}"] = beta(n, s, moving_sum(both, h), h, series[f"{x}_mean{h}"], series[f"{x}_var{h}"])
    return out


def report_factors(close, known) -> dict[str, np.ndarray]:
    """``fundamentals.daily_fundamentals``; ``known(item)`` is an item in force by session."""
    k = {c: known(c) for c in CARRIED}
    cap = close * k["shares"]
    cap = np.where(cap > 0, cap, np.nan)
    ev = zero(cap) + zero(k["total_debt"]) - zero(k["cash"])
    invested = zero(k["total_equity"]) + zero(k["long_term_debt"])
    op = zero(k["ebitda_ttm"]) + zero(k["rd_ttm"])
    net_debt = zero(k["total_debt"]) - zero(k["cash"])
    fixed = zero(k["ppe"]) + zero(k["current_assets"]) - zero(k["current_liabilities"])
    return {c: k[c] for c in fundamentals.REPORT_RATIOS} | {
        "PE": ratio(close, k["eps_ttm"]), "PB": ratio(close, k["bvps"]), "SIZE": np.log(cap),
        "PSALES": ratio(k["sales_ttm"], cap), "EVSALES": ratio(k["sales_ttm"], ev), "EVEBIT": ratio(k["ebit_ttm"], ev),
        "EVEBITDA": ratio(k["ebitda_ttm"], ev), "PTB": ratio(zero(k["total_equity"]) - zero(k["intangibles"]), cap),
        "ROA": ratio(k["ni_ttm"], k["total_assets"]), "GROSSMARGIN": ratio(k["gp_ttm"], k["sales_ttm"]),
        "ROIC": ratio(k["ni_ttm"], invested), "OPRDA": ratio(op, k["total_assets"]), "OPRDIC": ratio(op, invested),
        "GBROC": ratio(k["ebit_ttm"], fixed), "DEBITDA": ratio(k["total_debt"], k["ebitda_ttm"]),
        "LTDE": ratio(k["long_term_debt"], k["total_equity"]), "LTDEBITDA": ratio(k["long_term_debt"], k["ebitda_ttm"]),
        "NDEBITDA": ratio(net_debt, k["ebitda_ttm"]), "STKP": ratio(zero(k["issued_ttm"]) + zero(k["bought_ttm"]), cap),
        "POCF": ratio(k["ocf_ttm"], cap), "PFCF": ratio(k["fcf_ttm"], cap), "EVOCF": ratio(k["ocf_ttm"], ev),
        "EVFCF": ratio(k["fcf_ttm"], ev), "FCFROIC": ratio(k["fcf_ttm"], invested), "CAPEXPPE": ratio(k["capex_ttm"], k["ppe"]),
    }


def rating_balance(net, total, days: np.ndarray) -> np.ndarray:
    """(ups - downs) / all actions over 7 calendar days, 0 where there were none."""
    first = np.searchsorted(days, days - 6)  # counts are whole, so differences of their sums are exact
    over = [np.concatenate([np.zeros((len(x), 1)), x.cumsum(1)], 1) for x in (net, total)]
    net, total = (x[:, 1:] - x[:, first] for x in over)
    return zero(ratio(net, total))


def _reports_in_force(held: dict, rows: np.ndarray, names: int, days: int):
    """The item in force at each session, by name of the item."""
    where = held["place"][rows], held["t"][rows]
    order = np.lexsort((held["x"][rows], where[1], where[0]))
    name, t = where[0][order], where[1][order]
    items = held["items"][rows[order]]
    # A null leaves the symbol's earlier value in force, column by column.
    at = np.where(np.isnan(items), -1, np.arange(len(items))[:, None])
    at = np.maximum.accumulate(at, 0) if len(items) else at
    starts = np.searchsorted(name, name)
    items = np.where(at >= starts[:, None], np.take_along_axis(items, np.maximum(at, 0), 0), np.nan)
    last = np.full((names, days), -1)
    last[name, t] = np.arange(len(t))  # of one session the last row stands
    last = np.maximum.accumulate(last, 1)
    table = np.concatenate([items, np.full((1, len(CARRIED)), np.nan)])  # row -1: nothing known
    return lambda item: table[:, CARRIED.index(item)][last]


def weekly_rows(shared, cols: Sequence[str]):
    """Arrow batches of (symbol, t, kind, x, y, items) sorted by symbol to one row a symbol and week."""

    def block(table: pa.Table) -> pa.RecordBatch | None:
        series, days, labels, sessions = shared.value
        symbol = table.column("symbol").combine_chunks()
        keys = symbol.to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        place, names = new.cumsum() - 1, int(new.sum())
        t, kind = table.column("t").to_numpy(), table.column("kind").to_numpy()
        x, y = (table.column(c).cast(pa.float64()).to_numpy() for c in ("x", "y"))
        shape = names, len(days)
        bar = np.flatnonzero(kind == BAR)
        last = np.full(shape, -1)
        last[place[bar], t[bar]] = t[bar]
        traded = last >= 0
        last = np.maximum.accumulate(last, 1)
        close = np.full(shape, np.nan)
        close[place[bar], t[bar]] = x[bar]
        px = np.where(last >= 0, np.take_along_axis(close, np.maximum(last, 0), 1), np.nan)
        wanted, out = set(cols), {}

        def keep(found: dict[str, np.ndarray]) -> None:
            for name in wanted & found.keys():
                got = np.full((names, len(labels)), np.nan)
                padded = np.concatenate([found[name], np.full((names, 1), np.nan)], 1)
                for k in range(sessions.shape[1]):  # from a week's last session back
                    got = np.where(np.isnan(got), padded[:, sessions[:, k]], got)
                out[name] = got

        with np.errstate(all="ignore"):
            keep(price_factors(px, close))
            if wanted & RSI_SPANS.keys():
                keep(rsi(close))
            if wanted & {*factors.PRICE_FACTORS[8:], *factors.MARKET_FACTORS}:
                keep(risk_factors(px, series, bool(wanted & {*factors.MARKET_FACTORS})))
            betas = [c for c in cols if c.startswith("BETA_")]
            if betas:
                keep(sensitivities(px, series, [c.removeprefix("BETA_") for c in betas]))
            if wanted & {*fundamentals.FACTORS}:
                rows = np.flatnonzero(kind == REPORT)
                items = np.full((len(kind), len(CARRIED)), np.nan)
                if len(rows):
                    texts = table.column("items").drop_null().to_pylist()
                    items[rows] = [list(map(float, text.split(","))) for text in texts]
                keep(report_factors(close, _reports_in_force({"place": place, "t": t, "x": x, "items": items}, rows, *shape)))
            if RATINGS in wanted:
                rows = np.flatnonzero(kind == ACTIONS)
                net, total = np.zeros(shape), np.zeros(shape)
                net[place[rows], t[rows]], total[place[rows], t[rows]] = x[rows], y[rows]
                keep({RATINGS: rating_balance(net, total, days)})
        # A symbol has rows from the week of its first bar on.
        begun = np.where(traded.any(1), traded.argmax(1), len(days))
        name, week = np.nonzero(sessions[:, 0][None, :] >= begun[:, None])
        return pa.RecordBatch.from_arrays(
            [symbol.take(pa.array(np.flatnonzero(new)[name])), pa.array(labels[week].astype(np.int32), pa.int32()).cast(pa.date32()),
             *[pa.array(out[c][name, week], pa.float64(), from_pandas=True) for c in cols]], names=["symbol", "date", *cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, CELLS // max(1, len(shared.value[1])))
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            keys = held.column("symbol").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            while len(starts) > most:  # the last symbol may go on in the next batch
                yield block(held.slice(starts[0], starts[most] - starts[0]))
                starts = starts[most:]
            held = held.slice(starts[0])
        if held is not None and held.num_rows:
            yield block(held)

    return run


def weekly(bars: DataFrame, cal: DataFrame, cols: Sequence[str], series: Sequence[DataFrame] = (), reports: DataFrame | None = None,
           actions: DataFrame | None = None, signal_day: str = "THU", weeks: DataFrame | None = None, symbols: int = 0,
           lag_days: int = 90) -> DataFrame:
    """(symbol, date, cols): the last value of each factor in every week from a symbol's first bar on.

    ``series`` are tables with a row per session, ``t``, and the columns that the factors read.
    """
    spark, cols = bars.sparkSession, list(cols)
    days = cal.select("t", F.unix_date("date").alias("day"), F.unix_date(ts.week_of("date", signal_day)).alias("week")).orderBy("t").toArrow()
    day, week = (np.asarray(days.column(c)).astype(np.int64) for c in ("day", "week"))
    known = {}
    for table in series:
        rows = table.orderBy("t").toArrow()
        known |= {c: np.asarray(rows.column(c).cast(pa.float64()).fill_null(np.nan)) for c in rows.column_names if c not in ("t", "date")}
    labels = np.unique(week)
    if weeks is not None:
        labels = np.intersect1d(labels, [r[0] for r in weeks.select(F.unix_date("date")).distinct().collect() if r[0] is not None])
    ends = np.searchsorted(week, labels, side="right")
    sizes = ends - np.searchsorted(week, labels)
    back = np.arange(max([1, *sizes.tolist()]))
    # The sessions of each week, newest first; past its first one a place that holds nan.
    sessions = np.where(back[None, :] < sizes[:, None], ends[:, None] - 1 - back, len(day)).astype(np.int64)
    shared = spark.sparkContext.broadcast((known, day, labels, sessions))

    kind = lambda k: F.lit(k).cast("tinyint").alias("kind")
    none = F.lit(None).cast("double")
    # Items go as text, which keeps every digit: for an array Spark measures the whole batch at each row.
    empty = F.lit(None).cast("string").alias("items")
    at = F.broadcast(cal.select("date", F.col("t").cast("int").alias("t")))
    rows = bars.join(at, "date").select("symbol", "t", kind(BAR), F.col("close").cast("double").alias("x"), none.alias("y"), empty)
    if reports is not None and {*cols} & {*fundamentals.FACTORS}:
        metrics = fundamentals.report_metrics(fundamentals.with_debt_fallback(reports))
        eff = joins.effective_reports(metrics, cal, lag_days)
        rows = rows.union(eff.select(
            "symbol", F.col("t").cast("int"), kind(REPORT), F.unix_date("eff").cast("double"), none,
            F.concat_ws(",", *[F.coalesce(F.col(c).cast("double").cast("string"), F.lit("nan")) for c in CARRIED])))
    if actions is not None and RATINGS in cols:
        counts = factors.action_counts(actions).join(at, "date")
        rows = rows.union(counts.select("symbol", "t", kind(ACTIONS), F.col("net").cast("double"), F.col("total").cast("double"), empty))
    rows = rows.filter("symbol is not null").repartition(ts.tasks_for(spark, symbols), "symbol").sortWithinPartitions("symbol")
    schema = bars.select("symbol").schema.add("date", "date")
    for c in cols:
        schema = schema.add(c, "double")
    return rows.mapInArrow(weekly_rows(shared, cols), schema)
