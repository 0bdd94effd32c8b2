"""The reader of product mentions, which the core has too: see ``quilate.functions.titles``."""

from quilate.functions.titles import *  # noqa: F403
