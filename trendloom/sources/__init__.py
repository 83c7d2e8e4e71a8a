"""Readers and writers for the files of the weekly run."""
