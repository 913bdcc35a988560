"""Operators for training-data text. Nothing outside this subpackage imports it."""
