"""Size bounds that decide between two exact ways of doing the same thing.

None of these drops data: a table over a broadcast bound is joined by a
(salted) shuffle, a column over the exact-selection bound is narrowed down by
further passes.
"""

# A lookup side is broadcast only when a count of its rows and a measure of its
# bytes both stay under these.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

# A key with more than this share of a table's rows is spread over SALTS tasks.
# There can be at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.005
SALTS = 64
# Keys that the sketch of frequent keys follows: its counts are too low by less than 4 in so many rows.
SKETCHED_KEYS = 8192

# Rows an exact quantile may look at in one aggregation buffer or one window.
EXACT_ROWS = 100_000

# Rows that a task sorts about when a table is numbered.
PART_ROWS = 500_000

# Accuracy of the approximate quantiles that bracket an exact one, and the
# number of ranges a long sorted group is cut into.
SKETCH_ACCURACY = 2_000
RANGES = 256
