"""All registered queries of the library."""

from millrace import queries_explorer, queries_metrics, queries_text, queries_pages  # noqa: F401
from millrace.registry import ORACLES, QUERIES  # noqa: F401
