"""Whole jobs: align and collapse, and a command line for them."""
