"""Where grids come from: generators, lists, tables and images."""
