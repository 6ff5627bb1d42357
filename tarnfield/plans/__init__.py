"""Plan helpers: shared scratch tables and session settings."""
