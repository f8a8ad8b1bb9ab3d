"""Dataset curation, evaluation and packing jobs on PySpark DataFrames."""
