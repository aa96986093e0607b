"""Operators for training data: exact distinct counts, percentiles, token ids, source mixes, spam pages."""
