"""Readers and writers of documents, catalogues, dictionaries and statistics."""
