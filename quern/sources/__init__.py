"""Readers with stable line numbers, and writers for partitions, artifacts and scores."""
