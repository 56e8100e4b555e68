"""quadrille: a PySpark-native engine for measured objects, time series and gridded data."""
