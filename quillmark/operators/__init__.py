"""Operators over messages, turns, comments and profiles, each a DataFrame in and a DataFrame out."""
