"""All registered queries."""

from loamwork.plans import q_codemap, q_discovery, q_edges, q_facts, q_more, q_runs, q_scan  # noqa: F401
from loamwork.plans.registry import REGISTRY  # noqa: F401
