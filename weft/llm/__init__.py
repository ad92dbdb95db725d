"""Operators for large training-data pipelines. Nothing else in weft imports this subpackage."""
