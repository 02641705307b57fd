"""Field-to-lattice analytics and training-data operators on Spark DataFrames."""
