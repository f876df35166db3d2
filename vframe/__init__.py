"""Versioned tabular analysis and feature engineering on Spark."""
