"""Analytics on Spark for environmental sensor networks, gridded climate data and text corpora."""
