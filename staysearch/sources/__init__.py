"""Inputs and outputs: topics, change events, tables, exports, demo data."""
