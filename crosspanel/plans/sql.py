"""Shared SQL views for the comparison queries, written against the base tables."""

from __future__ import annotations


def week(day: str, signal_day: str = "THU") -> str:
    """Bin-end label of ``day`` for bins closing on ``signal_day``."""
    index = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"].index(signal_day) + 1
    return f"({day} + CAST(({index} - isodow({day}) + 7) % 7 AS INTEGER))"


# name -> (views it reads, body)
VIEWS: dict[str, tuple[str, str]] = {
    "trades": (
        "",
        """SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS symbol,
                  l_extendedprice / l_quantity AS price, l_extendedprice AS amount,
                  l_quantity AS quantity, l_orderkey, l_linenumber, l_partkey
           FROM lineitem WHERE isodow(l_shipdate) <= 5""",
    ),
    "bars": (
        "trades",
        """SELECT date, symbol, sum(amount) / sum(quantity) AS close, sum(quantity) AS volume
           FROM trades GROUP BY date, symbol""",
    ),
    "cal": (
        "trades",
        """SELECT date, row_number() OVER (ORDER BY date) - 1 AS t
           FROM (SELECT DISTINCT date FROM trades)""",
    ),
    "symbols": ("bars", "SELECT DISTINCT symbol FROM bars"),
    "grid": (
        "cal symbols bars",
        """SELECT c.date, c.t, s.symbol, b.close, b.volume,
                  last_value(b.close IGNORE NULLS) OVER (
                    PARTITION BY s.symbol ORDER BY c.t
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px
           FROM cal c CROSS JOIN symbols s
           LEFT JOIN bars b ON b.date = c.date AND b.symbol = s.symbol""",
    ),
    "market": (
        "trades",
        "SELECT date, sum(amount) / sum(quantity) AS mkt_close FROM trades GROUP BY date",
    ),
    "profile": (
        "",
        """SELECT s_suppkey AS symbol, n_name AS industry, r_name AS sector, r_name AS region
           FROM supplier JOIN nation ON s_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey""",
    ),
    "membership": (
        "",
        """SELECT l_suppkey AS symbol, CAST(min(l_shipdate) AS DATE) AS date_added,
                  CASE WHEN l_suppkey % 7 <> 0 THEN CAST(max(l_shipdate) AS DATE) END
                    AS date_removed
           FROM lineitem GROUP BY l_suppkey""",
    ),
    "macro": (
        "",
        """SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS series,
                  sum(o_totalprice) AS value
           FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1, 2""",
    ),
    "ratings": (
        "",
        """SELECT user_id AS symbol, CAST(ts AS DATE) AS date,
                  CASE event_type WHEN 'purchase' THEN 'upgrade' WHEN 'error' THEN 'downgrade'
                    ELSE 'maintain' END AS action, event_id AS seq FROM events""",
    ),
    "quarters": (
        "",
        """SELECT l_suppkey AS symbol,
                  CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY
                       AS DATE) AS date,
                  sum(l_extendedprice) AS ext,
                  sum(l_extendedprice * (1 - l_discount)) AS rev,
                  sum(l_extendedprice * l_tax) AS tax,
                  sum(l_extendedprice * l_discount) AS disc,
                  sum(l_quantity) AS qty
           FROM lineitem GROUP BY 1, 2""",
    ),
    "statements": (
        "quarters",
        """SELECT symbol, date, rev AS revenue, 0.4 * rev - tax AS gross_profit,
                  0.06 * ext - disc AS net_income, 0.2 * rev - tax AS ebit,
                  0.25 * rev - tax AS ebitda, 0.01 * rev AS interest_expense,
                  0.02 * ext AS research_expense, qty AS shares,
                  rev + s_acctbal AS total_equity, 3 * rev AS total_assets,
                  0.8 * rev AS total_debt, 0.5 * rev + 0.1 * tax AS long_term_debt,
                  0.3 * rev - 0.1 * tax AS short_term_debt, 0.1 * ext AS cash,
                  0.9 * ext AS current_assets, 0.5 * rev + tax AS current_liabilities,
                  0.05 * ext AS intangibles, 1.2 * rev AS ppe,
                  0.15 * rev - 0.5 * tax AS operating_cash_flow,
                  0.1 * rev - 0.5 * tax AS free_cash_flow, -0.05 * ext AS capex,
                  0.02 * disc AS stock_issued, -0.5 * tax AS stock_repurchased
           FROM quarters JOIN supplier ON s_suppkey = symbol""",
    ),
}


def view(name: str, reads: str, body: str) -> None:
    """Add a shared view; families define the ones only they need next to their queries."""
    if name in VIEWS:
        raise ValueError(f"view {name} defined twice")
    VIEWS[name] = (reads, body)


def with_clause(names: list[str]) -> str:
    """WITH clause holding the named views and everything they read, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        reads, _ = VIEWS[name]
        for dep in reads.split():
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) + "\n"
