"""Column-level building blocks: predicates, signatures, parsing steps, text decoding."""
