"""The operators that run on streams."""
