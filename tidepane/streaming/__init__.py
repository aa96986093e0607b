"""Ingestion of samples into panes, as batches or as a stream."""
