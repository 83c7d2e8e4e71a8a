"""The steps of the weekly run, each a composition of operators."""
