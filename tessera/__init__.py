"""Text analytics and language-model scoring on Spark."""
