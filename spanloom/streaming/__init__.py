"""spanloom.streaming."""
