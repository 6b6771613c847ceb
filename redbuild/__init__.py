"""CI-failure log analytics on Spark."""
