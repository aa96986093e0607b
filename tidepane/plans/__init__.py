"""Query text, workload plans and their validation."""
