"""Query registry: each operator as a Spark query with an independent SQL form."""
