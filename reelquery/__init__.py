"""reelquery: a PySpark-native engine for video-review analytics and corpus preparation."""
