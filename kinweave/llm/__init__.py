"""Operators for training data. Nothing else in kinweave imports this subpackage."""
