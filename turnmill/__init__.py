"""turnmill: Spark-native analytics for conversational transcripts.

Every operator is a function from DataFrames to a DataFrame, so Catalyst sees
one declarative plan; Arrow-batched Python is used only where no built-in
expression can state the semantics.
"""
