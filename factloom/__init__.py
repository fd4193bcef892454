"""Facts, identities and versions as Spark DataFrames."""
