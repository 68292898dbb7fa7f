"""Registered queries over the driver's tables."""

from . import retrieval  # noqa: F401

from . import scalars  # noqa: F401,E402

from . import rules  # noqa: F401,E402

from . import corpus  # noqa: F401,E402

from . import segments  # noqa: F401,E402
