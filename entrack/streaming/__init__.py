"""Keyed stream processors; each has a batch twin that gives the same result."""
