"""Procurement analytics as Spark DataFrame code.

Every public function takes and returns DataFrames (or Columns), stays lazy and
leaves the physical strategy to Catalyst and adaptive execution.
"""
