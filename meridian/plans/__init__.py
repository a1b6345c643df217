"""Plan-level helpers: cutting lineage and sizing broadcasts."""
