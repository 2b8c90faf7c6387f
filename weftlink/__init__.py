"""weftlink: record linkage and corpus preparation as plain Spark DataFrame plans."""
