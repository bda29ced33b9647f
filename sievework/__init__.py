"""sievework: caption, prompt and benchmark analytics as Spark DataFrame operators."""
