"""Exports. Text is made by Spark expressions; only what a single file needs passes through the driver."""
