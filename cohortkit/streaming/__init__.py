"""Streaming: incremental refresh of the dashboard indicators (see refresh.py)."""
