"""Operators for large text and ranking problems of training data; nothing else in the library imports them."""
