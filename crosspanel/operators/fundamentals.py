"""Report-based factors: trailing sums, publication lag, ratios against price."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.operators.joins import report_asof

# Flow items summed over four reports.
TRAILING = {
    "revenue": "sales_ttm", "gross_profit": "gp_ttm", "net_income": "ni_ttm", "ebit": "ebit_ttm",
    "ebitda": "ebitda_ttm", "interest_expense": "int_ttm", "research_expense": "rd_ttm",
    "operating_cash_flow": "ocf_ttm", "free_cash_flow": "fcf_ttm", "capex": "capex_ttm",
    "stock_issued": "issued_ttm", "stock_repurchased": "bought_ttm",
}
STOCK_ITEMS = [
    "shares", "total_equity", "total_assets", "total_debt", "long_term_debt", "cash",
    "current_assets", "current_liabilities", "intangibles", "ppe",
]
REPORT_RATIOS = ["eps_ttm", "bvps", "ROE", "GPOA", "DE", "NDE", "EBIT_COVER", "SALES_GROWTH_YOY",
                 "ACCRUALS"]

FACTORS = [
    "PE", "PB", "ROE", "GPOA", "DE", "NDE", "EBIT_COVER", "ACCRUALS", "SALES_GROWTH_YOY",
    "PSALES", "EVSALES", "EVEBIT", "EVEBITDA", "PTB", "ROA", "GROSSMARGIN", "ROIC", "OPRDA",
    "OPRDIC", "GBROC", "DEBITDA", "LTDE", "LTDEBITDA", "NDEBITDA", "STKP", "SIZE",
]
# Computed, but left out of the model's list for thin cash-flow coverage.
OPTIONAL_FACTORS = ["POCF", "PFCF", "EVOCF", "EVFCF", "FCFROIC", "CAPEXPPE"]


def _zero(col: str):
    return F.coalesce(F.col(col), F.lit(0.0))


def report_metrics(reports: DataFrame) -> DataFrame:
    """Per-report trailing sums and ratios; all windows share one sort by symbol."""
    w = Window.partitionBy("symbol").orderBy("date")
    out = reports.withColumns(
        {new: ts.rolling(F.sum, F.col(old), 4, window=w) for old, new in TRAILING.items()}
    )
    c, ratio = F.col, ts.ratio
    sales = F.last("revenue", ignorenulls=True).over(w)
    out = out.withColumns(
        {
            "_sales": sales,
            "_nca": _zero("current_assets") - _zero("cash"),
            "_ncl": _zero("current_liabilities") - _zero("short_term_debt"),
        }
    )
    moved = lambda col: c(col) - F.lag(col, 1).over(w)
    return out.withColumns(
        {
            "eps_ttm": ratio(c("ni_ttm"), c("shares")),
            "bvps": ratio(c("total_equity"), c("shares")),
            "ROE": ratio(c("ni_ttm"), c("total_equity")),
            "GPOA": ratio(c("gp_ttm"), c("total_assets")),
            "DE": ratio(F.nullif(c("total_debt"), F.lit(0.0)), c("total_equity")),
            "NDE": ratio(_zero("total_debt") - _zero("cash"), c("total_equity")),
            "EBIT_COVER": ratio(c("ebit_ttm"), c("int_ttm")),
            "SALES_GROWTH_YOY": ratio(c("_sales"), F.lag("_sales", 4).over(w)) - 1,
            "ACCRUALS": ratio(moved("_nca") - moved("_ncl"), c("total_assets")),
        }
    ).drop("_sales", "_nca", "_ncl")


def with_debt_fallback(reports: DataFrame) -> DataFrame:
    """total_debt where reported, else short-term plus long-term debt."""
    if "total_debt" in reports.columns:
        return reports
    return reports.withColumn("total_debt", _zero("short_term_debt") + _zero("long_term_debt"))


def daily_fundamentals(grid: DataFrame, reports: DataFrame, cal: DataFrame, lag_days: int = 90,
                       exact: bool = False) -> DataFrame:
    """Grid plus every factor; items become visible ``lag_days`` after the report date."""
    carried = [*TRAILING.values(), *STOCK_ITEMS, *REPORT_RATIOS]
    metrics = report_metrics(with_debt_fallback(reports))
    known = report_asof(metrics, carried, cal, lag_days, exact)
    out = grid.join(known, ["symbol", "t"], "left")
    c, ratio = F.col, ts.ratio
    cap = c("close") * c("shares")
    out = out.withColumn("mktcap", F.when(cap > 0, cap))
    out = out.withColumns(
        {
            "ev": F.nullif(_zero("mktcap") + _zero("total_debt") - _zero("cash"), F.lit(0.0)),
            "invested": F.nullif(_zero("total_equity") + _zero("long_term_debt"), F.lit(0.0)),
            "_op": _zero("ebitda_ttm") + _zero("rd_ttm"),
            "_fixed": _zero("ppe") + _zero("current_assets") - _zero("current_liabilities"),
        }
    )
    out = out.withColumns(
        {
            "PE": ratio(c("close"), c("eps_ttm")),
            "PB": ratio(c("close"), c("bvps")),
            "SIZE": F.ln("mktcap"),
            "PSALES": ratio(c("sales_ttm"), c("mktcap")),
            "EVSALES": ratio(c("sales_ttm"), c("ev")),
            "EVEBIT": ratio(c("ebit_ttm"), c("ev")),
            "EVEBITDA": ratio(c("ebitda_ttm"), c("ev")),
            "PTB": ratio(_zero("total_equity") - _zero("intangibles"), c("mktcap")),
            "ROA": ratio(c("ni_ttm"), c("total_assets")),
            "GROSSMARGIN": ratio(c("gp_ttm"), c("sales_ttm")),
            "ROIC": ratio(c("ni_ttm"), c("invested")),
            "OPRDA": ratio(c("_op"), c("total_assets")),
            "OPRDIC": ratio(c("_op"), c("invested")),
            "GBROC": ratio(c("ebit_ttm"), c("_fixed")),
            "DEBITDA": ratio(c("total_debt"), c("ebitda_ttm")),
            "LTDE": ratio(c("long_term_debt"), c("total_equity")),
            "LTDEBITDA": ratio(c("long_term_debt"), c("ebitda_ttm")),
            "NDEBITDA": ratio(_zero("total_debt") - _zero("cash"), c("ebitda_ttm")),
            "STKP": ratio(_zero("issued_ttm") + _zero("bought_ttm"), c("mktcap")),
            "POCF": ratio(c("ocf_ttm"), c("mktcap")),
            "PFCF": ratio(c("fcf_ttm"), c("mktcap")),
            "EVOCF": ratio(c("ocf_ttm"), c("ev")),
            "EVFCF": ratio(c("fcf_ttm"), c("ev")),
            "FCFROIC": ratio(c("fcf_ttm"), c("invested")),
            "CAPEXPPE": ratio(c("capex_ttm"), c("ppe")),
        }
    )
    return out.drop("_op", "_fixed")


def four_ratios(grid: DataFrame, ttm: DataFrame, cal: DataFrame, lag_days: int = 90) -> DataFrame:
    """PE, PB, ROE, GPOA from inputs that already are trailing sums."""
    items = ["net_income", "gross_profit", "total_equity", "total_assets", "shares"]
    known = report_asof(ttm, items, cal, lag_days)
    out = grid.join(known, ["symbol", "t"], "left")
    c, ratio = F.col, ts.ratio
    return out.withColumns(
        {
            "PE": ratio(c("close"), ratio(c("net_income"), c("shares"))),
            "PB": ratio(c("close"), ratio(c("total_equity"), c("shares"))),
            "ROE": ratio(c("net_income"), c("total_equity")),
            "GPOA": ratio(c("gross_profit"), c("total_assets")),
        }
    )
