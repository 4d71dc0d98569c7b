"""Readers and writers: tables, delimited grids, model artefacts."""
