"""Folioscope: measurement logs to model-ready tables, honest model scores and attributions.

Every public function takes and returns Spark DataFrames.
"""

__version__ = "0.1.0"
