"""spanloom: analytics over aligned document pairs on Spark."""
