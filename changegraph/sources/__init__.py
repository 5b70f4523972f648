"""Readers of diffs, facts, configuration and discussions, and sinks."""
