"""The mapping to a reference list, which the core has too: see ``quilate.operators.reference_map``."""

from quilate.operators.reference_map import *  # noqa: F403
