"""Reusable table operators that hold up when one key owns much of the data."""
