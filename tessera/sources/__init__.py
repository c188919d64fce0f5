"""Corpora, query files, saved indexes and binary posting files."""
