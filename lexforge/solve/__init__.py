"""Puzzle solvers: rule spaces as dimension tables, searched by joins and windows."""
