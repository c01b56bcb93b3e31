"""Readers and writers of the file formats the batch programs use."""
