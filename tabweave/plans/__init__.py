"""Facades, registries and the registered queries."""
