"""Epistrand: epiallele-aware DNA-methylation analytics as Spark DataFrames."""
