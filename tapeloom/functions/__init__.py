"""Column-level building blocks: window specs, ranks, recurrences, scalars."""
