"""Functions of values: numbers, comparisons, arrays and reducers, all as Spark columns."""
