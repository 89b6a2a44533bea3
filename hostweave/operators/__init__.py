"""DataFrame operators. Every function takes and returns DataFrames.

Tables may carry a ``scenario`` column (one value per input log). When it is
there, every operator works on each scenario separately in the same job.
"""
