"""All registered queries with their checks."""

from millrace.plans.catalogue import boards, cleaning, figures, files, joins, mining, quality, texts  # noqa: F401
from millrace.plans.catalogue.base import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
