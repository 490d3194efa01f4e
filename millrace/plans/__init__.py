"""Queries over the data folders, and their SQL."""
