"""DuckDB SQL that computes every table from `events`, written apart from the Spark code, for comparison."""
