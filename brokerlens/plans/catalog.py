"""All registered queries (importing the modules registers them)."""

from brokerlens.plans import q_core, q_detect, q_eval, q_io, q_models, q_profile, q_reports, q_stats  # noqa: F401
from brokerlens.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
