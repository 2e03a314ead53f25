"""Table-agnostic kernels: DataFrames in, DataFrames out, columns named by parameters."""
