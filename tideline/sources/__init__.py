"""Change-log sources: derived logs, transaction tables and snapshots."""
