"""Detection and policy-driven protection of sensitive fields."""
