"""Row-shape and relational steps on DataFrames."""
