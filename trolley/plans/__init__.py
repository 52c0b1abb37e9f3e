"""Finished reports: DataFrame functions (``reports``) and SQL text over views (``sqltext``)."""
