"""Readers, writers, configuration and the graph derived from the star-schema tables."""
