"""Operators on grids, frames and graphs."""
