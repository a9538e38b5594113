"""Record-linkage operators: DataFrame in, DataFrame out. Every pair join holds country as a key."""
