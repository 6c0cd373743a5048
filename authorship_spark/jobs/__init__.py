"""Whole jobs: verify pairs, and ingest files. ``queries`` registers what the driver runs."""
