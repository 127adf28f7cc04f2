"""Readers and writers: chunks, Markdown, binary uploads, catalogs, graph tables, keyed tables."""
