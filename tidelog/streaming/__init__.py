"""Streaming ingest with acknowledgements, and the service surface."""
