"""quernstone: ticket-corpus retrieval analytics on Spark DataFrames."""
