"""Relational steps that need more than one DataFrame method, and sinks."""
