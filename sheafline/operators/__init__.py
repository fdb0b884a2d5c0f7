"""Table, sheet and document operators over DataFrames."""
