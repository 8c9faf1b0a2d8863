"""Registered queries, by family. Each module has QUERIES and ORACLES."""
