"""Column-level building blocks: character classes, hashing, rounding, fixed word lists."""
