"""Checks on parameter tables, their merge, duplicates, and the computers of parameters."""
