"""Subpackage of siftline."""
