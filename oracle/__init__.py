"""DuckDB SQL that computes the same results as the Spark queries (the oracle)."""
