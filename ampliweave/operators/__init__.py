"""Operators from DataFrames to DataFrames: filters, radius joins, tag correction, pileups and consensus, references, graphs, cells, alignment."""
