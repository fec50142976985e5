"""Imports every catalog module so that their queries register."""

from . import catalog_search  # noqa: F401
from . import catalog_governance  # noqa: F401
from . import catalog_columns  # noqa: F401
from . import catalog_runs  # noqa: F401
from . import catalog_lake  # noqa: F401
from . import catalog_streaming  # noqa: F401
