"""MLlib training, scoring and evaluation over feature tables."""
