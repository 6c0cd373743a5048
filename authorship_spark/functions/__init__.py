"""Column functions: text, style vectors, scripts and distance kernels."""
