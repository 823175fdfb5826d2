"""Table analysis on Spark: what explains a business metric, at cluster scale.

The public entry points are re-exported here; see the README for the tour.
"""

from tableinsight.operators.anomaly import arrival_decisions, trailing_zscore
from tableinsight.operators.clean import clean
from tableinsight.operators.drivers import driver_analysis
from tableinsight.operators.inspection import inspect_table
from tableinsight.operators.joins import JoinConfigurationError, diagnose_join, join_tables
from tableinsight.operators.metric import entity_metric
from tableinsight.operators.profile import describe, profile_table
from tableinsight.operators.reconcile import reconcile_numbers
from tableinsight.plans.analyze import analyze, analyze_joined
from tableinsight.plans.guard import run_read_only, try_query

__all__ = [
    "JoinConfigurationError",
    "analyze",
    "analyze_joined",
    "arrival_decisions",
    "clean",
    "describe",
    "diagnose_join",
    "driver_analysis",
    "entity_metric",
    "inspect_table",
    "join_tables",
    "profile_table",
    "reconcile_numbers",
    "run_read_only",
    "trailing_zscore",
    "try_query",
]
