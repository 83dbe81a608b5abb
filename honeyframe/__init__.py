"""Records on a sparse hexagonal lattice, as PySpark DataFrame operators."""
