"""Operators for building training corpora: one module each, self-contained beside the rest of the package."""
