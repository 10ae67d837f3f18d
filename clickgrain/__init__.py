"""Customer-interaction analytics on Spark: plain ``DataFrame -> DataFrame`` operators."""
