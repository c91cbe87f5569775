"""Spark-first analytics over pipeline traces: graphs, schedules, simulation, trace repair."""
