"""All queries of the library, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stintlake.plans import comparisons, details, documents, fits, lineup, models, ratings, reports, rink_game, season, significance, streams, timeline, winning, xg

MODULES = (timeline, season, comparisons, models, rink_game, details, significance, documents, ratings, fits, streams, reports, lineup, xg, winning)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
