"""Column builders. Nothing in this package runs a job."""
