"""Operators for preparing text corpora; see ``queries`` for the registered ones."""
