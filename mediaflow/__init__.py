"""Labelled media datasets on Spark: tag, fetch, decode, shape, split, train, evaluate."""
