"""DataFrame operators: extraction stages, merging, cleaning, roll-ups."""
