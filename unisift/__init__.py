"""Text-safety analytics on Spark: files and text tables become relations of lines, characters, tokens and findings."""
