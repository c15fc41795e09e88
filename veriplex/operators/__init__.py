"""Operators on snapshots: logical plans over entries, and the authenticated tree under them."""
