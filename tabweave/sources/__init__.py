"""Readers of tables: DataFrames, CSV, TSV, Markdown, HTML, nested lists, and words with positions (PDF pages)."""
