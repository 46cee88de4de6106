"""bidloom: bid and quotation analytics on Spark DataFrames."""
