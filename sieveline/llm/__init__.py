"""Operators for preparing training data; self-contained, imported by nothing else in the library."""
