"""Corpus preparation for language models: ten operators on documents, pages and vectors."""
