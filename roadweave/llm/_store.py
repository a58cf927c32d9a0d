"""Intermediate tables; see ``roadweave.storage``."""

from ..storage import (  # noqa: F401
    discard,
    discard_since,
    discard_unread,
    fresh_path,
    made,
    made_since,
    materialize,
    qualified,
    release,
    shared_dir,
    short_batches,
)
