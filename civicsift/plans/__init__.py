"""Ready-made pipelines and the registry of benchmark queries."""
