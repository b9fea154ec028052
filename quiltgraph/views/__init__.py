"""Materialized pattern views: building, storing, answering with them, and keeping them up to date."""
