"""Run parameters, cost estimates and whole pipelines."""
