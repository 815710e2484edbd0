"""streetloom: a Spark-native engine for urban networks, geodata and large text corpora."""
