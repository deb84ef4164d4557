"""Relational operators over pools, traces, quotes and runs."""
