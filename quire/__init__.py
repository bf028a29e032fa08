"""A Spark engine for document corpora and reading activity."""
