"""Level-labelling and classification pipeline on Spark DataFrames."""
