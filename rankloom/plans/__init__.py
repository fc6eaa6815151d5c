"""Named queries over the landed tables (see ``catalog``)."""
