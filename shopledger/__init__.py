"""Manufacturing and supply-chain reports as lazy Spark DataFrame operators."""
