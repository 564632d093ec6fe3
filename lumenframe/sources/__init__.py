"""Readers, sinks, content keys and caches."""
