"""Compositions of operators: iteration, the workspace and its verbs."""
