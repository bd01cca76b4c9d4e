"""Corpus operators for training-data preparation.  Nothing outside this subpackage imports it."""
