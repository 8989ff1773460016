"""All registered queries."""

from workload import basics, charts, cleaning, deriving, profiling  # noqa: F401
from workload.base import ORACLES, QUERIES  # noqa: F401
