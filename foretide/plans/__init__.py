"""Named queries over the shared tables, each with the DuckDB SQL that must give the same rows."""
