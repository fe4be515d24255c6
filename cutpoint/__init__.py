"""Before/after comparison of a query workload on Spark: performance, cost and reliability."""

from cutpoint.config import Config, Thresholds, Tuning
from cutpoint.plans.workload import Workload

__all__ = ["Config", "Thresholds", "Tuning", "Workload"]
