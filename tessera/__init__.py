"""tessera: tissue-imaging and tabular analytics on PySpark DataFrames."""
