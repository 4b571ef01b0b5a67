"""Operators a training-data pipeline needs, over documents, pages, labels and benchmark items."""
