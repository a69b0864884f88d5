"""lensmark: grade rhetorical-method and structural-position markers with Spark."""
