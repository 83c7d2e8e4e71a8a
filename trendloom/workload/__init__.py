"""Queries over the sample tables, each with its counterpart in plain SQL."""
