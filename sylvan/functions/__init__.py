"""XPath values and functions as Spark columns."""
