"""Independent DuckDB SQL used as the correctness oracle for ``__spark_entry__``."""
