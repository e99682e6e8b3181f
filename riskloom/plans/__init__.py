"""Multi-step jobs, the derived tables the catalog queries run on, and the catalog itself."""
