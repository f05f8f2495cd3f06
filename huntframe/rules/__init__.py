"""Rules: their catalogue, libraries and predicates."""
