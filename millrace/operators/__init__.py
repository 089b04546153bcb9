"""DataFrame operators: schema work, merges, windows, tests, summaries."""
