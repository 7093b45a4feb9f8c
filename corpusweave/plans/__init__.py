"""Plan building blocks: skew-safe joins and ranks, closures, nested intervals."""
