"""sparkloom: a fluent, typed query surface and data-processing operators compiled to Spark DataFrames."""
