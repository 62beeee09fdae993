"""tidemark: social-content analytics as Spark DataFrame operators."""
