"""rolloutframe: rollouts, fine-tuning data and their metrics as Spark DataFrames."""
