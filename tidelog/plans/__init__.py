"""Registered queries over the engine and their oracles."""
