"""NumPy kernels: pure functions of a batch and a model, called from Arrow functions and tested by brute force."""
