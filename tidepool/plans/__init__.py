"""Cleaning as a plan: selection and configuration, the dependency graph, runs and their results, previews."""
