"""Queries that apply the operators to whole tables, and the tool registry."""
