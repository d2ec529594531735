"""A document and graph query engine on Spark whose query language is JSON Schema."""
