"""Operators for preparing text and vectors for language models; nothing outside imports it."""
