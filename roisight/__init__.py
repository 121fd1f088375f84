"""Spark-native radiomics: images as voxel tables, features as aggregates."""

__version__ = "0.1.0"
