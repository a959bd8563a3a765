"""Operators for preparing training data. Nothing else in gapwise imports this."""
