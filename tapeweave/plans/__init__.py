"""Domain tables over the test data and the registry of runnable queries."""
