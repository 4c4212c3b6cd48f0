"""Scriptorium: document-text analytics expressed as Spark DataFrame plans."""
