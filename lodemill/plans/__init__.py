"""Named queries over the tables, with the same in DuckDB SQL."""
