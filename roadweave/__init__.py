"""Road-traffic analytics expressed as Spark DataFrame plans."""
