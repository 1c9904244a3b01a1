"""DataFrame operators: they take and return DataFrames and never gather rows at the driver."""
