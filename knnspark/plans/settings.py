"""Index settings for tables of thousands of rows; constants.py has the production ones."""

K, ROUNDS, PROBES, UNIFORM = 32, 2, 2, 4
EXTRA = (0, 0, 2, 6, 2, 1)
THRESHOLDS = (0, 0, 0, 0, 0, 1_000_000)
#: LEVELS is the SQL's: enough for partitions of up to 2,048 rows; the query splits as often as it has to.
LEAF, LEVELS = 128, 4
