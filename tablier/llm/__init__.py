"""Corpus operators for language-model training data; nothing outside this folder imports them."""
