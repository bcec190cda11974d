"""loam: a Spark-native engine for preparing, auditing and scoring text corpora.

Every operator maps DataFrames to a DataFrame.  The subpackage ``llm`` holds
the operators for training data; nothing outside it imports it.
"""
