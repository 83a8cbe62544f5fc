"""Readers and writers: data lists, array files, reports."""
