"""Readers and writers for questionnaires, dictionaries, id lists and result tables."""
