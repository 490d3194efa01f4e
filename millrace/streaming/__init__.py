"""Streaming forms of the windowed queries. Each takes streaming (or static) DataFrames and returns one."""
