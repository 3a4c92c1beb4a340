"""skyframe: frame-stack analytics over Spark tables of pixels, frames, stars and catalogs."""
