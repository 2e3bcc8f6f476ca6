"""Part of the usage-log engine."""
