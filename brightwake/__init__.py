"""brightwake: a Spark-native activity-intelligence and text-processing engine."""
