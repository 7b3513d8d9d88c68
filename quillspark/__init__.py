"""Catalogue curation, querying and auditing as Spark DataFrame transformations."""
