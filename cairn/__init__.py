"""Cairn: a PySpark-native engine for spatial, raster and keyframe analytics."""
