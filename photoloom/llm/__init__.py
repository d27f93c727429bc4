"""Operators of training-data pipelines: mapping, matching, encoding, packing, text quality."""
