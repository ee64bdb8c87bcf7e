"""Readers and writers of raw and gridded series."""
