"""DataFrame operators of versioned tables: snapshots, change data, statistics, pruning, lookups."""
