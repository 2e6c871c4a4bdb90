"""Readers and writers: corpora, manifests, diffs, rule tables, saved state."""
