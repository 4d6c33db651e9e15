"""Data quality on Spark: rules, violations, quarantine, audit and seeded corruption."""
