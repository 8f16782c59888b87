"""Column-level building blocks: rules, ranks, exact selections, hash draws."""
