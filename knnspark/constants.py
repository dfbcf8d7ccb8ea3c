"""Fixed values of the scoring model."""

SCALE, SENTINEL, DIMS, TOP = 10000, -10000, 14, 5
MAX_AMOUNT, MAX_INSTALLMENTS, MAX_RATIO, MAX_MINUTES, MAX_KM, MAX_TX_24H, MAX_MERCHANT_AVG = 10000, 12, 10, 1440, 1000, 20, 10000
# Risk by merchant category code (fixed values); any other code has the default.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
MCC_DEFAULT = 0.50
# Production settings of the clustered index (fixed values): clusters, probes, further probes by fraud count.
CLUSTERS, PROBES, ESCALATE = 4096, 8, (8, 8, 32, 192, 56, 16)
# Distance above which a unanimous fast vote is searched again, by fraud count; 0 means never (fixed values).
WORST = (0, 0, 0, 0, 0, 100905918)
# Rows that train a production index, its Lloyd rounds, rows of a leaf at most, rows it was set for (fixed values).
SAMPLE, LLOYD, LEAF_ROWS, SIZED_FOR = 65536, 6, 128, 3000000
