"""Plans from events to cubes."""
