"""DataFrame operators: rules, violations, history, quarantine, metrics, corruption."""
