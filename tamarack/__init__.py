"""Product-catalogue engine on Spark: extraction, upsert, search and analytics as DataFrames."""
