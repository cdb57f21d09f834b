"""Streams: documents arriving in a folder become graphs and index entries."""
