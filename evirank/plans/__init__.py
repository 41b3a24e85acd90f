"""Compositions of the operators: feature table, products, training and evaluation."""
