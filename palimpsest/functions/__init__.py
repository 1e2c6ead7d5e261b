"""Column functions and the rule tables they read."""
