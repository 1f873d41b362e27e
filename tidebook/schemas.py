"""Schemas of the tables that operators read and write, as DDL."""

RAW_BOOK = "timestamp string, bids string, asks string"
BOOK = "symbol string, us bigint, bids array<array<double>>, asks array<array<double>>"
L2_UPDATE = "symbol string, seq bigint, us bigint, action string, id bigint, price double, size double, side string"
INGESTION_LOG = "filename string, type string, record_count int"
FOLDS = "fold_id int, fold_type string, start_us bigint, end_us bigint, n_samples bigint"
SPLITS = "split_id int, validation_folds array<int>"
RANGES = "split_id int, kind string, start_us bigint, end_us bigint"
