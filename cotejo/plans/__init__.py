"""Ready-made queries over the test tables, each with a counterpart in plain SQL."""
