"""sparkloom: a Spark-native engine for profiling tables and building, checking and executing SQL samples."""
