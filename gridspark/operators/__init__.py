"""Operators on grids: flow, walks, stencils and loads."""
