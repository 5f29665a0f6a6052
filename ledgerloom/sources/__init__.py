"""Readers of artifact directories."""
