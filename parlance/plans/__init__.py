"""Query catalogue. Importing this package registers every plan."""

from parlance.plans import registry  # noqa: F401
from parlance.plans import turn_plans  # noqa: F401
from parlance.plans import corpus_plans  # noqa: F401
from parlance.plans import feature_plans  # noqa: F401
from parlance.plans import log_plans  # noqa: F401
from parlance.plans import eval_plans  # noqa: F401
from parlance.plans import model_plans  # noqa: F401
from parlance.plans import source_plans  # noqa: F401
from parlance.plans import stream_plans  # noqa: F401
from parlance.plans import intake_plans  # noqa: F401
from parlance.plans.registry import REGISTRY


def queries():
    return {name: p.build for name, p in REGISTRY.items()}


def oracle_sql():
    return {name: p.sql for name, p in REGISTRY.items() if p.sql is not None}
