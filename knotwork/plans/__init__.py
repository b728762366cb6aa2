"""Solvers for one component, and the Spark plans that run them on all components."""
