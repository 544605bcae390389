"""End-to-end plans: the six queries, the insight run and the report."""
