"""spanloom.operators."""
