"""Column functions: everything here is an expression that Spark compiles."""
