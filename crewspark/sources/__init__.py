"""Readers and writers of delimited text, workbooks and contact cards."""
