"""Transaction-line analytics expressed as Spark DataFrame and SQL plans."""
