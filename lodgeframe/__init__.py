"""Hotel-chain analytics as Spark DataFrame functions."""
