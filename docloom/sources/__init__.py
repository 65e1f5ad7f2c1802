"""Readers, sinks and caches."""
