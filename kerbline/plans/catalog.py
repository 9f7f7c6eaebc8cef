"""All registered queries."""

from kerbline.plans import matches, reads, rides, streams  # noqa: F401
from kerbline.plans.registry import QUERIES  # noqa: F401
