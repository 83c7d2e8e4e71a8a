"""Weekly trend-tag to catalog-product matching, written for Spark."""
