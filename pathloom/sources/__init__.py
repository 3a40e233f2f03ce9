"""Where events, cubes, settings and results come from and go to."""
