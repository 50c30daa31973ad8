"""Where the four tables come from and go to: CSV, SQL dump rows, Parquet, the test mapping; key checks."""
