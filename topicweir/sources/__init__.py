"""Readers and writers: decks, dictionaries, result files, models."""
