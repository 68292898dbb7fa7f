"""Analytics over dockets of case files and the document corpora behind them, on Spark DataFrames."""
