"""Market analytics as Spark jobs: indicators, rankings, backtests, positions, opinions."""
