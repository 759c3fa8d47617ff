"""Readers and writers: label directories, response trees, tables."""
