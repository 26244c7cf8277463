"""PySpark-native analytics for gridded emission inversions, and operators for training corpora."""
