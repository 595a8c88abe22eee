"""Operators over whole graphs: graph computing and changes."""
