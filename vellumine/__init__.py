"""Document-quality analytics on Spark: cleaning, Markdown conversion, scoring and ranking of texts."""
