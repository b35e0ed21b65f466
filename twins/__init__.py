"""DuckDB SQL with the meaning of each query, used only to check results."""
