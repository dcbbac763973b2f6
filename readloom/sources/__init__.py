"""Readers and writers of read files, dictionaries and archives."""
