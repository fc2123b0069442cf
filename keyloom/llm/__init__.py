"""Operators for large training-data corpora. Nothing else in keyloom imports this subpackage."""
