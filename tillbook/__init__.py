"""Retail sales and stock analytics as Spark DataFrame functions."""
