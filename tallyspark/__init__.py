"""tallyspark: trade reconciliation on DataFrames, and operators for training-data corpora."""
