"""A molecule kernel in plain Python and its Spark functions."""
