"""The analytics stages, each a set of DataFrame-to-DataFrame functions."""
