"""millrace: corpus curation and training-mixture analytics on Spark DataFrames."""
