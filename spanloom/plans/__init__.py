"""spanloom.plans."""
