"""Availability and price search for accommodation inventory, built on Spark DataFrames."""
