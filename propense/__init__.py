"""Find the users who are likely to take up an item, on Spark."""
