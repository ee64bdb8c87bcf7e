"""Chains of operators over the driver tables; importing this package registers every query."""

from .. import queries  # noqa: F401
from ..registry import ORACLE_SQL, QUERIES  # noqa: F401
from . import cleaning, comparisons, coverage_views, evaluation, fitting, labels, scoring  # noqa: F401
