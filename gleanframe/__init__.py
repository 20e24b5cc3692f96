"""Data operators for web collection and training corpora on Spark."""
