"""DataFrame -> DataFrame operators: merge, lookup, mutation, set algebra, maintenance."""
