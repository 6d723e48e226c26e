"""Streaming ingest: new sales files validated into the snapshot as they land."""
