"""A PySpark engine for labelled subgraph patterns and materialized pattern views."""
