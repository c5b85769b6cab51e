"""Importing this module registers every query (see ``catalog``)."""

from . import transform_queries  # noqa: F401
from . import quality_queries  # noqa: F401
from . import run_queries  # noqa: F401
from . import history_queries  # noqa: F401
from . import source_queries  # noqa: F401
from . import discovery_queries  # noqa: F401
