"""Typed properties of object definitions."""
