"""All queries and oracles outside the training-text operators; importing the plans registers them."""

from __future__ import annotations

from quern.plans import heldout, q_metrics, q_more, q_relational, q_sampling, q_tasks, q_text, q_tokens  # noqa: F401
from quern.queryset import ORACLES, QUERIES  # noqa: F401
