"""Imports every query family so that its queries register."""

from crosspanel.plans import (  # noqa: F401
    factors,
    forecast,
    joins,
    modelling,
    portfolio,
    profiling,
    research,
    sources,
    technicals,
    timeseries,
    universe,
)
