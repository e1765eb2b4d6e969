"""Storage: commit log, tables, catalog, Arrow IPC files."""
