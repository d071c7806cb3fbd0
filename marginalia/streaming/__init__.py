"""Streams: idempotent ingest, progress of stages, retention."""
