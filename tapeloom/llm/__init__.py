"""Training-data operators over documents and vectors. Nothing else in the package imports this one."""
