"""Part of the snapshot engine."""
