"""Column functions: text keys, identifiers, years, authors, hashes, addresses."""
