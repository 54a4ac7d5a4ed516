"""spanloom.sources."""
