"""Readers and writers: chat exports, source repositories, the stored corpus."""
