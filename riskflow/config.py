"""Preset for the card-fraud tables: key, target, feature lists, defaults.

Every function in the package takes its column names as arguments; this module only saves typing for
the two-table fraud layout.
"""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------------------------
TABLE_KEY = "TransactionID"
TARGET = "isFraud"
UNKNOWN_TARGET = -1
OTHER = "Other"
NULL_TOKEN = "nan"
CATEGORY_SHARE = 90.0
FREE_TEXT_THRESHOLD = 1000
SEED = 42
TRAIN_FRACTION = 0.8
ROWS_PER_FILE = 50_000
COMPRESSION = "snappy"
ECE_BINS = 10
DECISION_THRESHOLD = 0.5
SPLITS = ("train", "test")
# Raw file, interim folder, whether an absent target is filled with the mark of an unknown one.
RAW_TABLES = (
    ("train_identity.csv", "train/identity", False),
    ("train_transaction.csv", "train/transactions", False),
    ("test_identity.csv", "test/identity", False),
    ("test_transaction.csv", "test/transactions", True),
)

CATEGORICAL_FEATURES = [
    "ProductCD",
    *(f"card{i}" for i in range(1, 7)),
    "DeviceType",
    "DeviceInfo",
    *(f"id_{i:02d}" for i in range(12, 39)),
]

USED_FEATURES = [
    "TransactionDT",
    "TransactionAmt",
    "ProductCD",
    "DeviceType",
    "DeviceInfo",
    *(f"card{i}" for i in range(1, 7)),
    "dist1",
    "dist2",
    *(f"C{i}" for i in range(1, 10)),
    *(f"id_{i:02d}" for i in range(1, 39)),
]

# Raw columns holding numbers; every other raw column is text.
NUMERIC_RAW_COLUMNS = r"TransactionDT|TransactionAmt|dist\d+|addr\d+|[CDV]\d+|id[-_](0[1-9]|1[01])"
# --- end of fixed values ------------------------------------------------------------------------
