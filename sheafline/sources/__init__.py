"""Readers that turn files into rows, and writers."""
