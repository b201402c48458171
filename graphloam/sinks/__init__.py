"""Where graphs, changes and results go."""
