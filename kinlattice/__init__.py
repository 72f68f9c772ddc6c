"""kinlattice: a Spark-native analytics engine for family-history data."""
