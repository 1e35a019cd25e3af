"""Operators of a training-data pipeline over `documents`, `pages` and `embeddings`.

Nothing outside this folder imports it, so the rest of the library works without it.
"""
