"""Whole jobs made of operators: building a corpus, answering a request from it."""
