"""Column functions on sample arrays, and small numpy kernels for Arrow batches."""
