"""Readers of catalog documents, snapshots and subtitles, and adapters of analytic tables."""
