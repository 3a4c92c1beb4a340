"""Runnable queries, one module per family; importing a module registers its queries."""

MODULES = ["stack_queries", "point_queries", "archive_queries", "sky_queries", "stencil_queries", "star_queries", "burst_queries", "run_queries"]
