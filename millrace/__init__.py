"""Table analytics on Spark: cleaning, quality checks, joins, KPIs, mining, models and streams."""

from millrace.session import build_session, tune

__all__ = ["build_session", "tune"]
