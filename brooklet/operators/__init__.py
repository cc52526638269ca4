"""Operators on DataFrames of the store's memories (schema.MEMORY) and entities."""
