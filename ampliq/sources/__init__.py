"""Readers of sequence, alignment, classification and control files."""
