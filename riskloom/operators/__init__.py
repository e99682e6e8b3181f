"""DataFrame jobs.  Each is ``f(df, ..., parameters) -> DataFrame``: lazy, no wall clock."""
