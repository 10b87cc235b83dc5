"""Column-level building blocks: decoding, identifiers, labels, time of day."""
