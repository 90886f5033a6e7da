"""Multi-step plans: skew-safe ordered scans, salted joins, operator chains."""
