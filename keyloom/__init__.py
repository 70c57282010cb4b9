"""keyloom: n-ary joinable-table discovery on Spark DataFrames."""
