"""functions of the raster and pairing engine."""
