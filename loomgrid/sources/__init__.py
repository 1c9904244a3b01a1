"""Readers and writers of annotation stores."""
