"""Structured Streaming forms: keyed upsert, chat history, event windows."""
