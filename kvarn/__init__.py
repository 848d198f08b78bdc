"""Versioned key-value analytics on Spark."""

import os

# Small matrices only: BLAS threads gain nothing here, and a pool made before the JVM is forked can hang.
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
