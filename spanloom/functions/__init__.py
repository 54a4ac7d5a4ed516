"""spanloom.functions."""
