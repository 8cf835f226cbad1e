"""Part of the lakemill engine."""
