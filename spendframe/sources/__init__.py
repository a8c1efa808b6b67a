"""Readers, mappers and writers."""
