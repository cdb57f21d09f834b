"""Operators on TableSets and GraphSets: normalizing, classifying, building, indexing, retrieving, rendering."""
