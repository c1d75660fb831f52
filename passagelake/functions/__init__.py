"""Column functions: everything here is a Spark expression without Python on the executors."""
