"""Operators for the preparation of training data; the rest of the library does not use them."""
