"""loomline: time-stamped text, interval and catalog analytics as Spark DataFrame operators."""
