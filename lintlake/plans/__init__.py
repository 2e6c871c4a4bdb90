"""Plan-level helpers, derived inputs and the registered queries."""
