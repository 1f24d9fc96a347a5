"""tidelog: analysis and processing of event logs as Spark DataFrames and streams."""
