"""Reusable plan shapes: skew-safe timelines, ranks, as-of and interval joins."""
