"""Public-transport timetable and train-tracking analytics as Spark DataFrames."""
