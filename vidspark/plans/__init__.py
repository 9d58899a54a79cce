"""Logical plans: predicates from Python lambdas, and the choice of tables."""
