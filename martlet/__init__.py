"""Retail decision support on Spark: table-level operators over a star schema
of customers, products and order lines.  Every operator takes DataFrames and
returns a lazy DataFrame."""
