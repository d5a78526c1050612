"""Functions over text and arrays."""
