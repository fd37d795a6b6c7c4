"""pitchside: league statistics as Spark DataFrame jobs.

Every statistic is computed for all competitions and seasons in one job;
the (competition, season) pair is a grouping key, never a loop variable.
"""

__all__ = ["schema", "session"]
