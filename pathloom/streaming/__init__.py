"""Cubes that follow new days."""
