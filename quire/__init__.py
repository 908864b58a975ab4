"""Quire: document-structure analytics on Spark."""
