"""Streams of documents over the batch operators."""
