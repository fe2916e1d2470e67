"""Column-expression builders and UDF/UDTF registration."""
