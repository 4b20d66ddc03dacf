"""Spark-native labelling of short free-text records.

Every public function takes and returns DataFrames unless it says otherwise.
"""
