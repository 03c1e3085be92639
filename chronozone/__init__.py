"""Part of the key and time range engine."""
