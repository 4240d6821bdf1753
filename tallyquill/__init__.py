"""tallyquill: document question-answering analytics on Spark DataFrames."""

__version__ = "0.1.0"
