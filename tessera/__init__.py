"""Code-evidence search and navigation over corpora held as DataFrames."""
