"""Measures and operators over cubes."""
