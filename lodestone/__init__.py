"""Lodestone: code-index analytics over C and C++ sources, and training-data operators, on PySpark."""
