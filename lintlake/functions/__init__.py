"""Column-level building blocks. Everything here maps Column to Column."""
