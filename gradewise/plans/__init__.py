"""Query catalogue: named Spark jobs over the driver's tables, each with the
equivalent DuckDB SQL used as a correctness oracle."""
