"""A datacube and data-preparation engine on PySpark DataFrames."""
