"""Connected components; see ``roadweave.operators.components``."""

from ..operators.components import connected_components  # noqa: F401
