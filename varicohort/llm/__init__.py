"""Operators on texts: packing, mixing and shared spans. Nothing else in the library imports this."""
