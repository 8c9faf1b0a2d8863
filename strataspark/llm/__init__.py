"""Operators for preparing text and code corpora; nothing outside this folder imports it."""
