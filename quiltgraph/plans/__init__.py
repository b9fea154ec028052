"""Pattern analysis and planning, in plain Python on the driver."""
