"""Transforms over streams of documents."""
