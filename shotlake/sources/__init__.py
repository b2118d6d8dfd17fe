"""Readers and writers of what the external tools leave behind."""
