"""The given tables projected onto the library's schemas, the queries over them, and their SQL."""
