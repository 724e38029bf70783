"""DataFrame operators: DataFrame in, DataFrame out, lazy unless they say otherwise."""
