"""Stateful streaming versions of the operators and their sinks."""
