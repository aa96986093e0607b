"""Readers, writers and the wire format of pushed samples."""
