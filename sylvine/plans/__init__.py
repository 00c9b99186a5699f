"""Driver-side planners and the search plan."""
