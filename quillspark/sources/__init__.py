"""Tables, the catalogue that is derived from them, and JSON files."""
