"""Named scalar, array, map and string expressions over columns (built-ins only)."""

from tessera.functions.expressions import *  # noqa: F403
