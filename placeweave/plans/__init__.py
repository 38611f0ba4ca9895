"""Whole analyses composed from the operators; each returns frames, some over tables written while it is set up."""
